"""Normal forms of titles, sellers and references, and lenient parsing, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Title words that identify nothing, in plain Latin letters.
TITLE_STOPWORDS = (
    "dzialka dzialki dzialke dzialek budowlana budowlane budowlany budowlanej dom domu domy domek sprzedam sprzedaz sprzedazy sprzeda okazja pilnie "
    "oferta nieruchomosc super piekna piekny piekne atrakcyjna atrakcyjny atrakcyjne cena tanio bez posrednikow polecam idealna idealny idealne blisko "
    "centrum gmina gm miejscowosc ul ulica nr ar arow ary m2 mkw pod zabudowe jednorodzinna jednorodzinny wolnostojacy na w z do od i o przy oraz dla to "
    "ten ta jest lub obok kolo km min minut nowy nowa nowe duza duzy duze mala maly male ladna ladny ladne widok widokowa widokiem spokojna spokojnej "
    "okolica okolicy okolice cicha cichej zielona zieleni lasu las rezerwacja mpzp wz warunki pozwolenie pnb media prad woda gaz"
).split()
# Seller names that identify nobody.
GENERIC_SELLERS = ["prywatny", "osoba prywatna", "wlasciciel", "private"]
# Words of agency names that identify no agency.
SELLER_NOISE = (
    "nieruchomosci nieruchomosc nieruchomoci biuro biura agencja agencji posrednictwo posrednictwa obrotu obrot sp zoo z o oo sc spj spk sa ska s c k j a "
    "spolka group grupa partners partner estate estates realestate real kancelaria firma oddzial oddzialu od i ii iii iv v vi vii nr franchise franczyza "
    "ltd llc gmbh home homes house dom domy property properties invest investment investments rynek pierwotny wtorny development developer deweloper"
).split()
MARKED = "ąáàâäãåāćčçďęéèêëěíìîïłľĺńňñóòôöõőřŕśšşťúùûüůűýÿźżž"
PLAIN = "aaaaaaaacccdeeeeeeiiiilllnnnoooooorrssstuuuuuuyyzzz"


def plain(text: Column) -> Column:
    """Lower case without diacritics."""
    return F.translate(F.lower(text), MARKED, PLAIN)


def words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(plain(text), "[^a-z0-9]+", " ")), " ")


def title_tokens(title: Column) -> Column:
    """Distinct title words of three letters or more that aren't stop words, in order."""
    kept = F.filter(words(title), lambda w: F.length(w) >= 3)
    return F.array_distinct(F.filter(kept, lambda w: ~w.isin(TITLE_STOPWORDS)))


def bigrams(tokens: Column) -> Column:
    """Distinct pairs of neighbouring characters of the joined words, each as one number: words hold ASCII only."""
    joined = F.array_join(tokens, "")
    code = lambda k: F.ascii(F.substring(joined, k, F.lit(1)))
    pairs = F.transform(F.sequence(F.lit(1), F.length(joined) - 1), lambda k: code(k) * 128 + code(k + 1))
    return F.when(F.length(joined) >= 2, F.array_distinct(pairs)).otherwise(F.array().cast("array<int>"))


def dice(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(2 * shared / (F.size(a) + F.size(b)))


def title_similarity(a: Column, b: Column, bigrams_a: Column, bigrams_b: Column) -> Column:
    """Larger Dice of words and letter pairs; null if either title has fewer than two words."""
    return F.when((F.size(a) >= 2) & (F.size(b) >= 2), F.greatest(dice(a, b), dice(bigrams_a, bigrams_b)))


def seller_tokens(name: Column) -> Column:
    generic = F.trim(plain(name)).isin(GENERIC_SELLERS)
    kept = F.array_distinct(F.filter(words(name), lambda w: (F.length(w) >= 2) & ~w.isin(SELLER_NOISE)))
    return F.when(name.isNull() | generic, F.array().cast("array<string>")).otherwise(kept)


def same_seller(a: Column, b: Column) -> Column:
    """The shorter list of identity words lies within the longer, and isn't one short word alone."""
    small, big = F.when(F.size(a) <= F.size(b), a).otherwise(b), F.when(F.size(a) <= F.size(b), b).otherwise(a)
    within = F.size(F.array_except(small, big)) == 0
    strong = (F.size(small) >= 2) | (F.length(F.array_join(small, "")) >= 4) | (F.size(small) == F.size(big))
    return (F.size(small) > 0) & within & strong


def advertiser_key(name: Column, own_id: Column) -> Column:
    own = F.lower(F.trim(own_id))
    norm = F.regexp_replace(plain(F.trim(name)), r"\s+", " ")
    return F.when(F.length(own) > 0, own).when((F.length(norm) > 0) & ~norm.isin(GENERIC_SELLERS), norm)


def identity_keys(internal_id: Column, *references: Column) -> Column:
    """Keys that name the same advertisement anywhere: platform ids and distinctive references."""
    made = [F.when(internal_id.rlike(r"^\d+$"), F.concat(F.lit("mg:"), internal_id))]
    for raw in references:
        ref = F.regexp_replace(F.lower(F.trim(raw)), r"\s+", "")
        made.append(F.when((F.length(ref) >= 5) & (ref.rlike("[^0-9]") | (F.length(ref) >= 6)), F.concat(F.lit("ref:"), ref)))
    return F.array_distinct(F.array_compact(F.array(*made)))


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(plain(text), "[^a-z0-9]+", "-"), F.lit("-"))


def lenient_number(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, r"[\s  ]", ""), F.lit(","), F.lit(".")).try_cast("double")


def number_in_text(text: Column) -> Column:
    """First number of a label such as '1 900 zł'."""
    return lenient_number(F.regexp_extract(F.regexp_replace(text, r"[\s  ]", ""), r"\d+(?:[.,]\d+)?", 0))


def area_label(label: Column) -> Column:
    """Square metres of a label; hectares count 10 000, ares 100."""
    tight = F.lower(F.regexp_replace(label, r"[\s  ]", ""))
    number = F.replace(F.regexp_extract(tight, r"^([\d.,]+)(m²|m2|ha|ar|a)?", 1), F.lit(","), F.lit(".")).try_cast("double")
    unit = F.regexp_extract(tight, r"^([\d.,]+)(m²|m2|ha|ar|a)?", 2)
    return number * F.when(unit == "ha", 10000.0).when(unit.isin("ar", "a"), 100.0).otherwise(1.0)


def local_time(text: Column, zone: str = "Europe/Warsaw") -> Column:
    """UTC time of an ISO time with a zone, or of a local one without."""
    zoned = text.rlike(r"([zZ]|[+-]\d{2}:\d{2})$")
    return F.when(zoned, F.try_to_timestamp(text)).otherwise(F.to_utc_timestamp(F.try_to_timestamp(F.replace(text, F.lit("T"), F.lit(" ")), F.lit("yyyy-MM-dd HH:mm:ss")), zone))


def strip_html(html: Column, length: int = 500) -> Column:
    out = F.regexp_replace(F.regexp_replace(html, r"(?i)<br\s*/?>", " "), "<[^>]+>", " ")
    for ref, char in (("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'")):
        out = F.replace(out, F.lit(ref), F.lit(char))
    out = F.substring(F.trim(F.regexp_replace(out, r"\s+", " ")), 1, length)
    return F.when(F.length(out) > 0, out)


# Named character references and what they stand for.
REFERENCES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "sup2": "²", "sup3": "³", "deg": "°", "ndash": "–", "mdash": "—", "hellip": "…", "zwnj": "", "zwj": ""}


def decoded(text: Column) -> Column:
    """Character references resolved, unknown names left as they are; narrow and fixed spaces become plain ones."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"&#(?:[xX][0-9a-fA-F]{1,6}|[0-9]{1,7});"), F.lit(0)))
    code = lambda r: F.when(F.lower(F.substring(r, 3, 1)) == "x", F.conv(F.regexp_extract(r, r"&#[xX](\w+);", 1), 16, 10)).otherwise(F.regexp_extract(r, r"&#(\d+);", 1)).try_cast("int")
    char = lambda r: F.when(code(r) <= 0x10FFFF, F.decode(F.unhex(F.lpad(F.hex(code(r)), 8, "0")), "UTF-32")).otherwise("")
    out = F.aggregate(found, text, lambda t, r: F.replace(t, r, char(r)))
    for name, value in [*((k, v) for k, v in REFERENCES.items() if k != "amp"), ("amp", "&")]:
        out = F.replace(out, F.lit(f"&{name};"), F.lit(value))
    return F.regexp_replace(out, "[\u00a0\u2007\u2009\u202f]", " ")


def digits(text: Column) -> Column:
    """The number that a text's digits make, spaces and words between them left out; a comma is the decimal mark."""
    kept = F.regexp_replace(decoded(text), r"[^\d,.]", "")
    return F.regexp_replace(kept, "^([^,]*),", "$1.").try_cast("double")


def local_day(day: Column, zone: str = "Europe/Warsaw") -> Column:
    """UTC time at which a local day begins."""
    return F.to_utc_timestamp(day.cast("timestamp"), zone)


def age_days(text: Column) -> Column:
    """Days of a relative age in Polish: days, weeks of 7, months of 30."""
    low = plain(text)
    n = F.coalesce(F.regexp_extract(low, r"(\d+)", 1).try_cast("int"), F.lit(1))
    return F.when(low.rlike("dzis|godz|minut"), 0).when(low.rlike("wczoraj"), 1).when(low.rlike("tydz|tygod"), n * 7).when(low.rlike("mies"), n * 30).when(low.rlike(r"\bdni|dzien"), n)


MONTHS = "stycznia lutego marca kwietnia maja czerwca lipca sierpnia września października listopada grudnia".split()  # fixed values: January to December


def month_name_date(text: Column) -> Column:
    low = F.lower(text)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(low, r"\d+\s+(\S+)\s+\d{4}", 1)).cast("int")
    return F.when(month > 0, F.make_date(F.regexp_extract(low, r"(\d{4})", 1).try_cast("int"), month, F.regexp_extract(low, r"^\D*(\d{1,2})", 1).try_cast("int")))


ROOMS = "one two three four five six seven eight nine ten".split()  # fixed values: 1 to 10


def rooms(word: Column) -> Column:
    at = F.array_position(F.array(*map(F.lit, ROOMS)), F.lower(word)).cast("int")
    return F.coalesce(word.try_cast("int"), F.when(at > 0, at))


def active_hour(ts: Column, start: int, end: int, zone: str = "Europe/Warsaw") -> Column:
    """Whether the local hour lies in [start, end), past midnight too; equal ends mean always."""
    hour = F.hour(F.from_utc_timestamp(ts, zone))
    if start == end:
        return F.lit(True)
    return (hour >= start) & (hour < end) if start < end else (hour >= start) | (hour < end)


def split_location(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: F.length(x) > 0)


def money(amount: Column) -> Column:
    """Whole amount with spaces between thousands and the currency."""
    return F.concat(F.replace(F.format_number(amount, 0), F.lit(","), F.lit(" ")), F.lit(" zł"))


def escape_html(text: Column) -> Column:
    for char, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(ref))
    return text


def https_url(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^https?://[^\s]+$"), F.lit(False))


# Regions by the first two digits of a unit's code.
REGIONS = {
    "02": "dolnoslaskie", "04": "kujawsko-pomorskie", "06": "lubelskie", "08": "lubuskie", "10": "lodzkie", "12": "malopolskie", "14": "mazowieckie", "16": "opolskie",
    "18": "podkarpackie", "20": "podlaskie", "22": "pomorskie", "24": "slaskie", "26": "swietokrzyskie", "28": "warminsko-mazurskie", "30": "wielkopolskie", "32": "zachodniopomorskie",
}


def region(code: Column) -> Column:
    """Region of a unit's code; that of the home area for codes of none."""
    regions = F.create_map(*[F.lit(x) for pair in REGIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(regions, F.substring(code, 1, 2)), F.lit(REGIONS["12"]))


def location_path(code: Column, county: Column, name: Column, town: Column) -> Column:
    """region/county/unit; a town that is its own county stands twice."""
    own = town & (slug(name) == slug(county))
    return F.concat_ws("/", region(code), F.when(own, slug(name)).otherwise(slug(county)), slug(name))


def kind_of_label(label: Column, fallback: Column) -> Column:
    return F.when(label.rlike("(?i)^dom"), "house").when(label.rlike("(?i)^dzia"), "plot").otherwise(fallback)


def query_parameter(url: Column, name: str) -> Column:
    """Value of a URL's query parameter; null if it has none."""
    return F.nullif(F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1), F.lit(""))


def area_text(area: Column, kind: Column) -> Column:
    """Large plots in hectares with two decimals and a comma, else whole square metres."""
    hectares = F.concat(F.replace(F.format_number(area / 10000, 2), F.lit("."), F.lit(",")), F.lit(" ha"))
    metres = F.concat(F.replace(F.format_number(area, 0), F.lit(","), F.lit(" ")), F.lit(" m²"))
    return F.when((kind == "plot") & (area >= 10000), hectares).otherwise(metres)


def shortened(text: Column, length: int = 90) -> Column:
    """At most ``length`` characters; a longer text ends in an ellipsis three characters earlier."""
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length - 3), F.lit("…"))).otherwise(text)
