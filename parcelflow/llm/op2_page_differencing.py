"""Main text of web pages by differencing each page with its nearest neighbours in URL order.

Every page is parsed to text lines; a line has a place, the path of open block elements with their classes, and marks.
Of pages of a host with the same lines one represents all. Representatives are ordered by host, path and lines; a page's
partners are up to ``NEIGHBOURS`` pages of its host on either side. Page and partner are aligned by a longest common
subsequence of lines. A partner that differs by fewer than ``COPY_WORDS`` words on both sides is a copy and isn't asked.
What decides, in this order:

* scripts, styles, comments and the like are never lines; menus, footers, asides, forms and dialogs by HTML's own
  elements and roles, a header outside an article, and sections of reader comments are deleted;
* lines within ``article`` or ``main`` are kept, also those that partners share;
* any other line is deleted if one partner shares it, or two where there are more than two partners;
* a place where alignments found shared lines, on ``SHARING`` pages and one in ``RARE`` of its host or of several hosts at
  least, is a template, and its other lines are deleted too (a rotating advert, the menu's entry of the page itself), if
  what was shared is short and the rest isn't longer. Only aligned lines count, not how often a line occurs, and no class
  or id names an advert: without partners nothing outside the elements above is deleted.

Pages travel as hashes of lines until partners are found. Range splits are explicit keys, and the ``NEIGHBOURS`` pages on
either side of each are sent to both ranges, so results don't depend on the number of tasks and a host is spread.

Defined results: null or empty html gives an empty text; a null page_id is kept; a null or malformed url has no host and
no partner, only templates; repeated rows are pages of their own with equal results; an empty table gives no rows; other
columns play no part. Unclosed tags close where HTML closes them; a menu left open ends at the article; an attribute or
comment left open takes the rest of the page, as in browsers.
"""

from __future__ import annotations

import bisect
import html
import re
from collections import Counter, defaultdict, deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts, spread_join, staged

NEIGHBOURS, COPY_WORDS = 4, 20
SHARING, RARE, PLACE_HOSTS, SHORT = 2, 200, 3, 20
REPRESENTATIVES_A_TASK, ROWS_OF_BITS = 50_000, 1 << 26

# Fixed values of HTML: inline, void and raw-text elements, elements that end an open paragraph or item, page furniture.
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe svg textarea select title xmp noembed noframes".split())
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_FURNITURE = frozenset("nav footer aside form button menu dialog".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
_READERS = frozenset("comment comments comment-list commentlist comments-area comment-form respond replies disqus_thread".split())

_TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|(!--)|[!?/])")
_ATTRIBUTE = re.compile(r"[\s/]*+(?:(>)|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+([\"']|[^\s>\"'][^\s>]*+)?)?)")
_CLOSE = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in _RAW}
_DIGITS = re.compile(r"\d+")
MAIN, SKIP = 1, 2
PARSED = "page_id long, url string, host string, digest binary, lines array<string>, marks array<int>, places array<long>"
PAGES = "host string, path string, digest binary, hashes binary, places binary, words binary, marks binary"
DEALT = "pid int, own boolean, " + PAGES
SOLVED = "host string, digest binary, partners int, shared array<boolean>, places array<long>, kind int, place long, line long, words long, times long, hits long"


class _Open:
    """An open block element."""

    __slots__ = ("tag", "place", "main", "skip", "skips", "outer", "readers", "article_at", "closed")

    def __init__(self, tag: str, place: int, main: bool, skip: _Open | None, skips: int):
        self.tag, self.place, self.main, self.skip, self.skips = tag, place, main, skip, skips
        self.outer, self.readers, self.article_at, self.closed = None, False, None, False


def _attributes(page: str, at: int) -> tuple[int, dict[str, str]]:
    """Where the tag ends, or -1 if it doesn't, and its attributes that matter."""
    out = {}
    while True:
        m = _ATTRIBUTE.match(page, at)
        if m is None:
            return -1, out
        at = m.end()
        if m[1]:
            return at, out
        value = m[3] or ""
        if value in ('"', "'") and value:
            end = page.find(value, at)
            if end < 0:
                return -1, out
            value, at = page[at:end], end + 1
        name = m[2].lower()
        if name in ("class", "id", "role"):
            out.setdefault(name, value)


def blocks(page: str) -> tuple[list[str], bytes, list[int]]:
    """Text lines of a page in order, their MAIN and SKIP marks and their places. One pass over the page."""
    root = _Open("", 0, False, None, 0)
    stack, opened, text, found, at, head = [root], Counter(), [], [], 0, False

    def flush() -> None:
        if text:
            line = " ".join("".join(text).split())
            if line:
                found.append((line, stack[-1]))
            text.clear()

    def pop() -> _Open:
        gone = stack.pop()
        opened[gone.tag] -= 1
        return gone

    while True:
        m = _TAG.search(page, at)
        start = len(page) if m is None else m.start()
        if start > at and not head:
            text.append(html.unescape(page[at:start]))
        if m is None:
            break
        if m[2] is None:
            end = page.find("-->", start + 2) if m[3] else page.find(">", m.end())
            if end < 0:
                break
            at = end + (3 if m[3] else 1)
            continue
        close, tag = m[1], m[2].lower()
        at, attributes = (m.end() + 1, {}) if page.startswith(">", m.end()) else _attributes(page, m.end())
        if at < 0:
            break
        if tag in _RAW:
            if not close:
                if tag in ("textarea", "select", "iframe", "svg"):
                    text.append(" ")
                end = _CLOSE[tag].search(page, at)
                if end is None:
                    break
                at = end.start()
            continue
        if tag in _INLINE:
            if tag in ("br", "wbr", "img"):
                text.append(" ")
            continue
        flush()
        if tag in ("html", "body", "head"):
            head = tag == "head" and not close
            continue
        if close:
            if opened[tag] > 0:
                while (gone := pop()).tag != tag:
                    pass
                gone.closed = True
            continue
        for other in _ENDS.get(tag, ()):
            if stack[-1].tag == other or (len(stack) > 1 and stack[-1].tag == "p" and stack[-2].tag == other):
                while pop().tag != other:
                    pass
        if stack[-1].tag == "p":
            pop()
        if tag in _VOID:
            continue
        up = stack[-1]
        label = _DIGITS.sub("0", f"{attributes.get('class', '')}#{attributes.get('id', '')}") if attributes else ""
        here = _Open(tag, xxhash.xxh64_intdigest(f"{up.place}/{tag}.{label}") >> 1, up.main, up.skip, up.skips)
        names = {*attributes.get("class", "").lower().split(), attributes.get("id", "").lower()} if attributes else frozenset()
        here.readers = bool(names & _READERS) and tag != "main"
        if tag in ("article", "main") and not here.readers:
            here.main, skip = True, up.skip
            while skip is not None and skip.article_at is None:
                skip.article_at, skip = len(found), skip.outer
        elif here.skips < 50 and (here.readers or tag in _FURNITURE or (tag == "header" and not up.main) or attributes.get("role", "").lower() in _ROLES):
            here.skip, here.outer, here.skips = here, up.skip, up.skips + 1
        stack.append(here)
        opened[tag] += 1
    flush()
    marks = bytes(MAIN * x.main | SKIP * _skipped(x.skip, k) for k, (_, x) in enumerate(found))
    return [line for line, _ in found], marks, [x.place for _, x in found]


def _skipped(skip: _Open | None, line: int) -> bool:
    """Whether furniture holds the line; what was left open before an article, but for comments, ends there."""
    while skip is not None:
        if skip.closed or skip.readers or skip.article_at is None or line < skip.article_at:
            return True
        skip = skip.outer
    return False


def _forward(a: list[int], b: list[int], rows: list[int] | None) -> int:
    """Bits of a's positions without a step in b's last row; every row goes to ``rows``."""
    where: dict[int, int] = {}
    for k, line in enumerate(a):
        where[line] = where.get(line, 0) | 1 << k
    full = v = (1 << len(a)) - 1
    for line in b:
        u = v & where.get(line, 0)
        if u:
            v = ((v + u) | (v - u)) & full
        if rows is not None:
            rows.append(v)
    return v


def _steps(bits: int, n: int) -> np.ndarray:
    """Lengths of common subsequences with the first 0 to n positions."""
    raw = np.unpackbits(np.frombuffer(bits.to_bytes(-(-n // 8) or 1, "little"), np.uint8), bitorder="little")[:n]
    return np.concatenate([[0], np.cumsum(raw == 0)])


def common_lines(a: list[int], b: list[int], most: int = ROWS_OF_BITS) -> list[int]:
    """Indexes in ``a`` of the lines of a longest common subsequence with ``b``.

    Bit-parallel, a row a line of ``b``; sequences whose rows take over ``most`` bits are cut at the best middle.
    """
    low, n, m = 0, len(a), len(b)
    while low < n and low < m and a[low] == b[low]:
        low += 1
    while n > low and m > low and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    in_a, in_b = set(a[low:n]), set(b[low:m])
    at = [k for k in range(low, n) if a[k] in in_b]
    x, y = [a[k] for k in at], [line for line in b[low:m] if line in in_a]
    return [*range(low), *[at[k] for k in _inner(x, y, most)], *range(n, len(a))]


def _inner(a: list[int], b: list[int], most: int) -> list[int]:
    if not a or not b:
        return []
    if len(a) * len(b) > most and len(b) > 1:
        half = len(b) // 2
        first = _steps(_forward(a, b[:half], None), len(a))
        last = _steps(_forward(a[::-1], b[half:][::-1], None), len(a))[::-1]
        cut = int(np.argmax(first + last))
        return common_lines(a[:cut], b[:half], most) + [cut + k for k in common_lines(a[cut:], b[half:], most)]
    rows: list[int] = []
    _forward(a, b, rows)
    out, row, col = [], len(rows), len(a)
    while row and col:
        if rows[row - 1] >> (col - 1) & 1:
            col -= 1
        elif row > 1 and not rows[row - 2] >> (col - 1) & 1:
            row -= 1
        else:
            row, col = row - 1, col - 1
            out.append(col)
    return out[::-1]


def keys_of(pages: DataFrame) -> DataFrame:
    url = F.coalesce("url", F.lit(""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url",
        F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)).alias("host"),
        F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1).alias("path"), "html",
    )


def _lines_of(raw: str | None) -> tuple[bytes, np.ndarray, list[str], bytes, list[int]]:
    lines, marks, places = blocks(raw or "")
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, lines), np.uint64, len(lines))
    digest = xxhash.xxh128(hashes.tobytes() + marks)
    digest.update(np.array(places, np.int64).tobytes())
    return digest.digest(), hashes, lines, marks, places


def _reduced(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        for at in range(0, len(pdf), 500):
            rows = []
            for host, path, raw in pdf.iloc[at : at + 500].itertuples(index=False):
                digest, hashes, lines, marks, places = _lines_of(raw)
                if lines:
                    words = np.fromiter((line.count(" ") + 1 for line in lines), np.int32, len(lines))
                    rows.append((host, path, digest, hashes.tobytes(), np.array(places, np.int64).tobytes(), words.tobytes(), marks))
            yield pd.DataFrame(rows, columns=["host", "path", "digest", "hashes", "places", "words", "marks"])


def representatives(keyed: DataFrame) -> DataFrame:
    """One page of those of a host with equal lines, places and marks, the first in path order; hashes of its lines."""
    reduced = keyed.select("host", "path", "html").mapInPandas(_reduced, PAGES)
    rest = [c for c in reduced.columns if c not in ("host", "digest")]
    return reduced.groupBy("host", "digest").agg(F.min(F.struct(*rest)).alias("x")).select("host", "x.path", "digest", *[f"x.{c}" for c in rest[1:]])


def _edges(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The first and the last keys of a sorted range."""
    first, last = [], deque(maxlen=NEIGHBOURS)
    for pdf in frames:
        for key in pdf.itertuples(index=False):
            if len(first) < NEIGHBOURS:
                first.append(key)
            last.append(key)
    if first:
        out = first + [k for k in last if k not in first]
        yield pd.DataFrame(out, columns=["host", "path", "digest"])


def dealing(pages: DataFrame, tasks: int) -> tuple[list[tuple], dict[tuple, set[int]]]:
    """First key of each range, and the ranges that look at a key of another: a few keys a range come to the driver."""
    key = ["host", "path", "digest"]
    ranged = pages.select(*key).repartitionByRange(tasks, *key).sortWithinPartitions(*key)
    marked = ranged.mapInPandas(_edges, "host string, path string, digest binary").withColumn("pid", F.spark_partition_id())
    ends = sorted((r.host, r.path, bytes(r.digest), r.pid) for r in marked.collect())
    firsts, seen = [], set()
    for *k, pid in ends:
        if pid not in seen:
            seen.add(pid)
            firsts.append(tuple(k))
    also, keys = defaultdict(set), [tuple(k) for *k, _ in ends]
    for pid in range(1, len(firsts)):
        at = bisect.bisect_left(keys, firsts[pid])
        for k in keys[max(0, at - NEIGHBOURS) : at]:
            also[k].add(pid)
        for k in keys[at : at + NEIGHBOURS]:
            also[k].add(pid - 1)
    return firsts, dict(also)


def _deal(firsts: list[tuple], also: dict[tuple, set[int]]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for row in pdf.itertuples(index=False):
                key = (row.host, row.path, bytes(row.digest))
                pid = max(0, bisect.bisect_right(firsts, key) - 1)
                rows.append((pid, True, *row))
                rows += [(other, False, *row) for other in also.get(key, ()) if other != pid]
            yield pd.DataFrame(rows, columns=["pid", "own", "host", "path", "digest", "hashes", "places", "words", "marks"])

    return run


class _Page:
    def __init__(self, row):
        self.host, self.digest, self.own, self.pid = row.host, row.digest, row.own, row.pid
        self.hashes, self.words = np.frombuffer(row.hashes, np.int64).tolist(), np.frombuffer(row.words, np.int32)
        self.places, self.marks = np.frombuffer(row.places, np.int64), np.frombuffer(row.marks, np.uint8)


def votes(page: _Page, others: list[_Page]) -> tuple[np.ndarray, int]:
    """How many partners share each line, and how many partners there are; copies aren't partners."""
    count, partners = np.zeros(len(page.hashes), np.int32), 0
    for other in others:
        shared = common_lines(page.hashes, other.hashes)
        same = int(page.words[shared].sum())
        if int(page.words.sum()) - same < COPY_WORDS and int(other.words.sum()) - same < COPY_WORDS:
            continue
        partners += 1
        count[shared] += 1
    return count, partners


def furniture(count: np.ndarray, partners: int) -> tuple[np.ndarray, int]:
    """Lines that enough partners share, and the number of partners."""
    return count >= (1 if partners <= 2 else 2), partners


def _solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["host", "digest", "partners", "shared", "places", "kind", "place", "line", "words", "times", "hits"]
    out, seen, hits, before, waiting = [], Counter(), Counter(), deque(maxlen=NEIGHBOURS), deque()

    def solve() -> None:
        page = waiting.popleft()
        if page.own:
            count, partners = votes(page, [*before, *list(waiting)[:NEIGHBOURS]] if page.host else [])
            gone = furniture(count, partners)
            free = page.marks & (MAIN | SKIP) == 0
            places = page.places[free]
            out.append((page.host, page.digest, gone[1], gone[0], np.unique(places), 0, None, None, None, None, None))
            lines = {(place, line): words for place, line, words in zip(places.tolist(), np.array(page.hashes, np.int64)[free].tolist(), page.words[free].tolist(), strict=True)}
            seen.update((page.host, *k, words) for k, words in lines.items())
            aligned = free & (count > 0)
            met = set(zip(page.places[aligned].tolist(), np.array(page.hashes, np.int64)[aligned].tolist(), strict=True))
            hits.update((page.host, *k, lines[k]) for k in met)
        before.append(page)

    def drain(least: int) -> pd.DataFrame | None:
        if len(out) + len(seen) <= least:
            return None
        rows = out + [(host, None, None, None, None, 1, place, line, words, n, hits[host, place, line, words]) for (host, place, line, words), n in seen.items()]
        out.clear()
        seen.clear()
        hits.clear()
        longs = ("partners", "place", "line", "words", "times", "hits")  # nulls beside 64-bit numbers: never by way of floats
        return pd.DataFrame({k: pd.array(c, dtype="Int64") if k in longs else pd.Series(c, dtype=object) for k, c in zip(names, zip(*rows, strict=True), strict=True)})

    for row in chain((r for pdf in frames for r in pdf.itertuples(index=False)), [None]):
        if row is None or (waiting and row.host != waiting[-1].host):
            while waiting:
                solve()
            before.clear()
        elif len(waiting) > NEIGHBOURS:
            solve()
        if row is not None:
            waiting.append(_Page(row))
        if (got := drain(2000 if row is not None else 0)) is not None:
            yield got


def templates(solved: DataFrame) -> DataFrame:
    """Keys of the places that aligned lines show to be templates, on a host or, where they are, on several hosts."""

    def judged(sums: DataFrame, *by: str) -> DataFrame:
        sums = sums.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("lines", "hits", "words", "hit_words")])
        short = F.col("hit_words") <= SHORT * F.col("hits")
        alike = (F.col("words") - F.col("hit_words")) * F.col("hits") <= (2.5 * F.col("hit_words") + F.col("hits")) * (F.col("lines") - F.col("hits"))
        return sums.where((F.col("hits") >= SHARING) & (F.col("hits") * RARE >= F.col("lines")) & short & alike)

    sums = solved.where("kind = 1").groupBy("host", "place").agg(
        F.sum("times").alias("lines"), F.sum("hits").alias("hits"), F.sum(F.col("times") * F.col("words")).alias("words"), F.sum(F.col("hits") * F.col("words")).alias("hit_words"))
    hosts = judged(sums, "host", "place").select(F.xxhash64("host", "place").alias("key"))
    wide = sums.groupBy("place").agg(F.count("*").alias("n")).where(F.col("n") >= PLACE_HOSTS)
    every = judged(sums.join(wide, "place", "left_semi"), "place")
    return hosts.unionAll(every.select(F.xxhash64(F.lit(None).cast("string"), "place").alias("key")))


def decisions(pages: DataFrame, tasks: int | None = None) -> DataFrame:
    """(host, digest, partners, shared, templates) of every representative."""
    spark = pages.sparkSession
    reps = staged(representatives(keys_of(pages.select("page_id", "url", "html"))))
    tasks = tasks or max(parts(spark), -(-reps.count() // REPRESENTATIVES_A_TASK))
    dealt = reps.mapInPandas(_deal(*dealing(reps, tasks)), DEALT).repartitionById(tasks, F.col("pid")).sortWithinPartitions("host", "path", "digest")
    solved = staged(dealt.mapInPandas(_solve, SOLVED))
    found = staged(templates(solved))
    pages = solved.where("kind = 0").select("host", "digest", "partners", "shared", "places")
    asked = pages.select("host", "digest", F.explode("places").alias("place"))
    asked = asked.withColumn("key", F.explode(F.array(F.xxhash64("host", "place"), F.xxhash64(F.lit(None).cast("string"), "place"))))
    found = found.withColumn("is_template", F.lit(True))
    held = spread_join(asked, found, "key", "digest", salts=128).where("is_template").groupBy("host", "digest").agg(F.collect_set("place").alias("templates"))
    return pages.drop("places").join(held, ["host", "digest"], "left")


def _parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        for at in range(0, len(pdf), 500):
            some = pdf.iloc[at : at + 500]
            got = [_lines_of(raw) for raw in some.html]
            yield pd.DataFrame({"page": some.page, "url": some.url, "host": some.host, "digest": [x[0] for x in got], "lines": [x[2] for x in got], "marks": [list(x[3]) for x in got], "places": [x[4] for x in got]})


def main_text(pages: DataFrame, tasks: int | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page; partners, and the numbers of lines that differencing and templates deleted."""
    found = staged(decisions(pages, tasks)).withColumn("key", F.struct("host", "digest")).drop("host", "digest")
    keyed = keys_of(pages.select("page_id", "url", "html")).select(F.col("page_id").cast("string").alias("page"), "url", "host", "html")
    lines = keyed.mapInPandas(_parsed, PARSED.replace("page_id long", "page string")).withColumn("key", F.struct("host", "digest"))
    rows = lines.join(found, "key", "left")  # adaptive execution splits the rows of a page that fills a third of the table
    mark = lambda k: F.element_at("marks", k + 1)
    shared = lambda k: F.coalesce(F.element_at("shared", k + 1), F.lit(False))
    template = lambda k: F.coalesce(F.array_contains("templates", F.element_at("places", k + 1)), F.lit(False))
    free = F.when(F.size("lines") > 0, F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda k: mark(k).bitwiseAND(MAIN | SKIP) == 0)).otherwise(F.array().cast("array<int>"))
    article = lambda k: mark(k).bitwiseAND(MAIN) > 0
    kept = F.filter("lines", lambda _, k: (mark(k).bitwiseAND(SKIP) == 0) & (article(k) | ~(shared(k) | template(k))))
    rows = rows.withColumn("text", F.array_join(kept, "\n\n")).withColumn("differenced", F.filter(free, shared)).withColumn("templated", F.filter(free, lambda k: template(k) & ~shared(k)))
    return rows.select(F.col("page").cast("long").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"), F.coalesce("partners", F.lit(0)).alias("partners"), "differenced", "templated")


def op2_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
