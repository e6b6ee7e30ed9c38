import random
import re
import struct
import time
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelflow.llm import op2_page_differencing as op2
from parcelflow.llm import op6_vector_packing as op6
from parcelflow.llm import op7_mpeg_audio as op7
from parcelflow.llm import op8_mix_sources as op8

from .conftest import words


def page(body, head="<title>t</title>"):
    return f"<html><head>{head}</head><body>{body}</body></html>"


def slow_common(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            t[i][j] = t[i + 1][j + 1] + 1 if a[i] == b[j] else max(t[i + 1][j], t[i][j + 1])
    return t[0][0]


def test_common_lines_is_a_longest_common_subsequence():
    r = np.random.default_rng(1)
    for k in range(90):
        a, b = [[int(x) for x in r.integers(0, 5, r.integers(0, 12))] for _ in range(2)]
        got = op2.common_lines(a, b, most=(4, 30, 10**6)[k % 3])
        assert len(got) == slow_common(a, b) and got == sorted(got)
        it = iter(b)
        assert all(any(x == y for y in it) for x in (a[k] for k in got))


def extracted(spark, rows, tasks=None):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as pid", "'z' as lines", "'q' as host", "'d' as digest")
    return op2.main_text(df, tasks).collect()


def test_pages(spark):
    menu, foot = "<div>Home</div><div>News</div>", "<p>All rights reserved</p>"
    long = " ".join(f"word{k}" for k in range(30))
    rows = [
        (1, "http://a.org/x/1", page(f"{menu}<p>First &amp; best<br>story {long}</p>{foot}")),
        (2, "http://a.org/x/2?q=1", page(f"{menu}<p>Second   story</p><p>ends&nbsp;here {long}</p>{foot}")),
        (3, "http://b.org/1", page("<nav>m</nav><div class='ad'>buy</div><article><h1>T</h1><p><b>bold<br><p>two</p></article><footer>f</footer><script>var t='</p>';x()</script>")),
        (4, None, None), (5, "http://c.org/", ""), (6, "http://a.org/x/1", page(f"{menu}<p>First &amp; best<br>story {long}</p>{foot}")), (None, "http://d.org/1", page("<p>alone</p><!-- <p>not</p> -->")),
        (7, "http://e.org/1", page("<nav><ul><li>open menu<article><p>kept</p></article><section class='comments'><p>nice</p></section>")), (2**60 + 1, "x", page("<p>no host</p>")),
    ]
    for tasks in (1, 4):
        got = {r.page_id: r.text for r in extracted(spark, rows, tasks)}
        first = f"First & best story {long}"
        assert got == {1: first, 6: first, 2: f"Second story\n\nends here {long}", 3: "buy\n\nT\n\nbold\n\ntwo", 4: "", 5: "", None: "alone", 7: "kept", 2**60 + 1: "no host"}
    assert all(r.n_chars == len(r.text) for r in extracted(spark, rows)) and extracted(spark, [(1, None, None)])[0].text == ""
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert op2.main_text(empty).count() == 0


def test_differencing_decides_without_markup(spark):
    """Twelve pages of a host, none with a mark; the same pages on hosts of their own keep what only partners tell."""
    text = [" ".join(f"t{k}w{n}" for n in range(40)) for k in range(12)]
    adverts = [f"<div class='x{k}'><p>offer {k % 3} today</p></div>" for k in range(12)]
    body = [f"<div><ul><li>Home<li>News<li>Page {k % 4} of many</ul></div>{adverts[k]}<div class='body'><p>{text[k]}</p><p>Shared licence, all rights reserved</p></div>" for k in range(12)]
    together = [(k, f"http://a.org/{k:02}", page(body[k])) for k in range(12)]
    apart = [(k, f"http://a{k}.org/{k:02}", page(body[k])) for k in range(2)]
    for tasks in (1, 3):
        assert {r.page_id: r.text for r in extracted(spark, together, tasks)} == dict(enumerate(text))
    alone = {r.page_id: r.text for r in extracted(spark, apart)}
    assert all(text[k] in alone[k] and "Home" in alone[k] and "rights" in alone[k] for k in range(2))
    rows = extracted(spark, together)
    assert all(r.differenced and r.partners for r in rows)


def test_near_copies_and_articles_keep_what_they_share(spark):
    story = "".join(f"<p>{' '.join(f's{k}w{n}' for n in range(30))}</p>" for k in range(4))
    rows = [(k, f"http://a.org/{k}", page(f"<div>Menu</div><p>Print version {k}</p>{story}")) for k in range(4)]
    assert all(r.text.count("\n\n") == 5 and r.partners == 0 for r in extracted(spark, rows))  # copies of each other only
    marked = [(k, f"http://b.org/{k}", page(f"<div>Menu</div><article>{story}<p>{' '.join(f'p{k}w{n}' for n in range(50))}</p></article>")) for k in range(3)]
    assert all(r.text.count("\n\n") == 4 and "Menu" not in r.text for r in extracted(spark, marked))


def test_class_words_and_teasers_do_not_cut_articles(spark):
    body = "<div class='share-price'><p>prices</p></div><article class='comments-on-law'><p>law</p></article><div id='related-work'><p>work</p></div><article class='comment'><p>me too</p></article><aside><article>teaser</article></aside>"
    assert extracted(spark, [(1, "http://a.org/1", page(body))])[0].text == "prices\n\nlaw\n\nwork"


def test_long_pages_of_unclosed_quotes_and_tags_take_one_pass():
    start = time.perf_counter()
    for piece in ("<a \"", "<p title=\"x>one</p>", "<a b = ", "<!-- ", "</p ", "<script>", "<nav>", "<p><i>", "&am", "<   ", "<a/ "):
        op2.blocks(piece * (1_000_000 // len(piece)))
    assert time.perf_counter() - start < 20
    assert op2.blocks("<p>a</p><p title=\"x>one</p>")[0] == ["a"] and op2.blocks("1 < 2 <b>x</b>")[0] == ["1 < 2 x"]


def test_lines_outside_an_article_are_differenced(spark):
    text = [" ".join(f"{n}{k}" for k in range(20)) for n in ("Long", "Short")]
    body = "<div>Home</div><div><p>{0} text, first part</p><p>{0} text, second part</p></div><article>Read {0} as well</article><article>Same teaser</article><p>All rights reserved</p>"
    got = {r.page_id: r.text.split("\n\n") for r in extracted(spark, [(k, f"http://a.org/{k}", page(body.format(name))) for k, name in enumerate(text)])}
    assert got == {k: [f"{name} text, first part", f"{name} text, second part", f"Read {name} as well", "Same teaser"] for k, name in enumerate(text)}


def slow_texts(rows):
    """The whole result by plain loops; lines, marks and places from the parser, shared lines from the alignment."""
    parsed = [(k, url, op2.blocks(raw or "")) for k, url, raw in rows]
    host_of = lambda url: (re.match(r"\w+://([^/?#:]+)", url or "") or [None, ""])[1].lower()
    path_of = lambda url: (re.match(r"\w+://[^/?#]*([^?#]*)", url or "") or [None, ""])[1]
    reps = {}
    for _, url, (lines, marks, places) in parsed:
        key = (host_of(url), tuple(lines), marks, tuple(places))
        if lines:
            reps[key] = min(reps.get(key, path_of(url)), path_of(url))
    digest = {key: op2._lines_of(next(raw for (_, u, raw), p in zip(rows, parsed, strict=True) if (host_of(u), tuple(p[2][0]), p[2][1], tuple(p[2][2])) == key))[0] for key in reps}
    votes, lines_at, hits_at = {}, defaultdict(list), defaultdict(list)
    for key in reps:
        host, lines, marks, places = key
        order = sorted((k for k in reps if k[0] == host), key=lambda k: (reps[k], digest[k]))
        at, count, partners = order.index(key), [0] * len(lines), 0
        for other in (order[max(0, at - 4) : at] + order[at + 1 : at + 5]) if host else []:
            shared = op2.common_lines([hash(x) for x in lines], [hash(x) for x in other[1]])
            rest = lambda ls, same: sum(len(x.split()) for x in ls) - same
            same = sum(len(lines[k].split()) for k in shared)
            if rest(lines, same) < 20 and rest(other[1], same) < 20:
                continue
            partners += 1
            for k in shared:
                count[k] += 1
        votes[key] = [c >= (1 if partners <= 2 else 2) for c in count]
        free = {(places[k], lines[k]) for k in range(len(lines)) if not marks[k] & 3}
        met = {(places[k], lines[k]) for k in range(len(lines)) if not marks[k] & 3 and count[k]}
        for place, line in free:
            lines_at[host, place].append(len(line.split()))
        for place, line in met:
            hits_at[host, place].append(len(line.split()))

    def template(spots):
        n, hits = [w for s in spots for w in lines_at[s]], [w for s in spots for w in hits_at.get(s, [])]
        return len(hits) >= 2 and len(hits) * 200 >= len(n) and sum(hits) <= 20 * len(hits) and (sum(n) - sum(hits)) * len(hits) <= (2.5 * sum(hits) + len(hits)) * (len(n) - len(hits))

    wide = defaultdict(list)
    for spot in lines_at:
        wide[spot[1]].append(spot)
    found = {s for s in lines_at if template([s])} | {s for spots in wide.values() if len(spots) >= 3 and template(spots) for s in spots}
    out = []
    for k, url, (lines, marks, places) in parsed:
        key = (host_of(url), tuple(lines), marks, tuple(places))
        kept = [x for n, x in enumerate(lines) if not marks[n] & 2 and (marks[n] & 1 or not (votes[key][n] or (key[0], places[n]) in found))]
        out.append((k, "\n\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize("seed", range(2))
def test_whole_result_equals_plain_loops(spark, seed):
    r = random.Random(seed)
    pool = [" ".join(f"o{k}w{n}" for n in range(r.randrange(2, 9))) for k in range(25)]
    own = lambda k, n: " ".join(f"t{k}x{r.randrange(10**6)}" for _ in range(n))
    rows = []
    for k in range(120):
        ad = f"<div class='{r.choice(['ad', 'promo'])}'>{r.choice(pool)}</div>"
        menu = "<ul>" + "".join(f"<li>{x}" for x in r.sample(pool, 3)) + "</ul>"
        text = "".join(f"<p>{own(k, r.randrange(5, 40))}</p>" for _ in range(r.randrange(1, 5)))
        body = f"{menu}{ad}" + (f"<article>{text}{r.choice(pool)}</article>" if r.random() < 0.5 else f"<div>{text}</div>") + r.choice(["", "<p>All rights reserved</p>", "<footer>f</footer>"])
        rows.append((k, f"http://h{r.randrange(4)}.org/{r.randrange(60)}", page(body)))
    rows += [(500 + k, u, h) for k, (_, u, h) in enumerate(r.sample(rows, 10))] + [(600, None, rows[0][2]), (601, "http://h1.org/", None)]
    got = sorted((x.page_id, x.text) for x in extracted(spark, rows, (None, 1, 5)[seed]))
    assert got == slow_texts(rows)


def test_without_partners_most_texts_keep_adverts(spark, monkeypatch):
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    whole = {x.page_id: x for x in op2.main_text(table).collect()}
    alone = {x.page_id: x.text for x in op2.main_text(table.withColumn("url", F.concat(F.lit("http://p"), F.col("page_id"), F.lit(".org/")))).collect()}
    worse = [k for k, x in whole.items() if len(alone[k]) > len(x.text)]
    assert len(worse) > 0.9 * len(whole) and all(whole[k].templated or whole[k].differenced for k in worse)


@pytest.mark.parametrize("n", [0, 1, 64, 121, 122, 1417, 1418, 100_000])
def test_media_round_trip(n):
    payload = bytes(k * 7 % 251 for k in range(n))
    media, found = op7.store(payload)
    assert op7.read_payload(media) == payload and found["bad_crc"] == found["skipped"] == 0 and found["table"]["frames"] == len(found["frames"]) and found["table"]["bytes"] == sum(x[1] for x in found["frames"]) + found["frames"][0][0] - (len(media) - 128 - found["table"]["bytes"])
    assert found["duration"] * 32000 == 1152 * len(found["frames"]) and found["tags"] == ["ID3v2.3", "ID3v1"]


def test_scanner_resynchronises_and_counts_bad_checksums():
    media = op7.write_stream(b"x" * 9000)
    whole = op7.scan(media)
    at = whole["frames"][2][0]
    hurt = media[:at] + b"junk\xff\xfb junk" + media[at:]
    found = op7.scan(hurt)
    assert len(found["frames"]) == len(whole["frames"]) and found["skipped"] == 11 and op7.read_payload(hurt) == b"x" * 9000
    flipped = bytearray(media)
    flipped[at + 8] ^= 1
    assert op7.scan(bytes(flipped))["bad_crc"] == 1
    assert op7.scan(b"")["frames"] == [] and op7.scan(b"no audio here")["skipped"] == 13


def test_media_columns(docs, rows, empty):
    got = op7.media_columns(docs).collect()
    assert len(got) == len(rows) and op7.media_columns(empty).count() == 0
    text = {d: (t or "").encode() for d, t, *_ in rows}
    for r in got:
        if r.doc_id is not None:
            raw = text[r.doc_id]
            padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
            assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(padded), zlib.crc32(padded[-64:]))


def test_mix_equals_sql_and_budgets(spark, docs, rows, tmp_path):
    con = duckdb.connect()
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/d")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = sorted(map(str, con.execute(op8.SQL).fetchall()))
    sizes = op8.staged(op8.sized(docs))
    got = op8.mix(sizes).select("doc_id", "size", "source_size", "target", "taken").collect()
    clean = lambda x: str(tuple(None if v is None or v != v else int(v) if k != 3 else float(v) for k, v in enumerate(x)))
    assert sorted(map(clean, got)) == sorted(clean(eval(w, {"nan": float("nan")})) for w in want)
    per = defaultdict(lambda: [0, 0.0])
    for r in op8.mix(sizes).collect():
        assert 0 <= r.taken <= 2 * r["size"]
        per[r.source][0] += r.taken
        per[r.source][1] = r.target
    assert all(abs(taken - target) <= 1 for taken, target in per.values())
    assert sum(t for _, t in per.values()) == pytest.approx(1.5 * sum(r["size"] for r in got))
    taken = op8.take(docs)
    assert taken.columns == docs.columns and taken.count() >= 1 and op8.take(docs.where("false")).count() == 0


def test_targets_reshare_excess(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), ("c", 1000)], "source string, size long").selectExpr("1L as doc_id", "source", "size", "'k' as key")
    got = {r.source: r.target for r in op8.targets(sizes).collect()}
    assert got["a"] == 20 and got["b"] == 200 and got["c"] == pytest.approx(1665 - 220)


def test_word_ids_equal_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, fast = Tokenizer.from_file(path), op6.WordIds(path, most=50)
    texts = ["", "a", "Don't we're \x85 x\xa0y", "A\x1cb", "<|endoftext|> x", "Ünï'S cödé's, 12ab İ ΑΣ ſ", "µm ª º × ÷ ÿ", "日本 語", "naïve… end.", "x.'s y'. 'll", words(300, 4), words(300, 5), words(300, 4)]
    for _ in range(2):
        for text, ids in zip(texts, fast.batch(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_assignment_respects_every_capacity(rule):
    r = np.random.default_rng(2)
    n = np.concatenate([r.integers(1, 200, 300), [200, 200]])
    sequence, offset = op6.assign(n, 200, most_docs=5, most_cost=30_000.0 + 10_000, rule=rule)
    for s in set(sequence.tolist()):
        own = sequence == s
        assert n[own].sum() <= 200 and own.sum() <= 5 and (n[own] ** 2).sum() <= 40_000
        order = np.argsort(offset[own])
        assert (offset[own][order] == np.concatenate([[0], np.cumsum(n[own][order])[:-1]])).all()


def test_pack(docs, rows, empty):
    got = op6.pack(docs).toPandas()
    assert op6.pack(empty).count() == 0 and got[got.piece == 0].shape[0] == len(rows)
    assert got[got.doc_id == 108].length.tolist().count(2048) >= 4 and got.length.max() == 2048
    assert got[got.doc_id == 102][["length", "ids_crc32"]].values.tolist() == [[1, zlib.crc32(bytes(4))]]
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.length.sum() <= 2048 and (g.offset.to_numpy() == np.concatenate([[0], g.length.cumsum()[:-1]])).all()
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) * 1.05 + 1


def best_fit(lengths, capacity, weights, rule):
    """Vector best fit written out: pieces in falling length, every open bin looked at."""
    bins, out = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need = [lengths[i] / capacity[0], 1 / capacity[1], lengths[i] ** 2 / capacity[2]]
        fits = []
        for b, room in enumerate(bins):
            if all(r >= x - 1e-12 for r, x in zip(room, need)):
                score = sum(w * x * r for w, x, r in zip(weights, need, room)) if rule == "dot" else -sum(w * (r - x) ** 2 for w, x, r in zip(weights, need, room))
                fits.append((-round(score, 12), b))
        if fits:
            b = min(fits)[1]
        else:
            b = len(bins)
            bins.append([1.0, 1.0, 1.0])
        out[i] = (b, round((1 - bins[b][0]) * capacity[0]))
        bins[b] = [r - x for r, x in zip(bins[b], need)]
    return [out[i] for i in range(len(lengths))]


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("capacity", [(100, 100, 10_000), (100, 3, 10_000), (100, 100, 4900), (100, 4, 6000)])
def test_best_fit_equals_brute_force(rule, capacity):
    r = np.random.default_rng(capacity[1] + capacity[2])
    lengths = r.integers(1, 60, 150)
    sequence, offset = op6.assign(lengths, *capacity, rule=rule)
    got, want = list(zip(sequence.tolist(), offset.tolist())), best_fit(lengths.tolist(), capacity, op6.WEIGHTS, rule)
    assert got == want


def test_packing_keeps_every_capacity(spark, docs):
    got = op6.pack(docs, most_docs=3, most_cost=2.0**21 + 1, length=1448).collect()
    per = defaultdict(list)
    for r in got:
        per[r.sequence_id].append((r.offset, r.length))
    assert len(got) == op6.pieces_of(docs, length=1448).count()
    for pieces in per.values():
        assert len(pieces) <= 3 and sum(n for _, n in pieces) <= 1448 and sum(n * n for _, n in pieces) <= 2**21 + 1
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n


def test_media_digests_are_those_of_the_stored_bytes(spark, docs, rows):
    import hashlib

    for r in op7.media_columns(docs.where("doc_id < 120")).collect():
        raw = next((t or "") for d, t, *_ in rows if d == r.doc_id).encode()
        payload = raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0")
        media = op7.write_stream(payload)
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.media_sha256 == hashlib.sha256(media).hexdigest() and r.media_bytes == len(media)
        at = media.index(b"Xing" if b"Xing" in media else b"Info") - 23
        at, want = at + op7.header(media[at : at + 4])[5], []
        while media[at : at + 3] != b"TAG":  # frames one after the other, by their headers alone
            want.append(at)
            at += op7.header(media[at : at + 4])[5]
        assert r.frame_offsets == want and r.seconds == len(want) * 1152 / 32000
    stored = op7.to_media(spark.createDataFrame([(1, b"abc" * 999)], "doc_id long, payload binary")).first()
    assert op7.read_payload(bytes(stored.media)) == b"abc" * 999 and len(stored.frame_offsets) == len(op7.scan(bytes(stored.media))["frames"])


def test_vbri_tables_and_checksums_of_layers_one_and_two():
    four = (0xFFFB9044).to_bytes(4)  # version 1, layer III without CRC, 128 kbit/s, 44.1 kHz
    size = op7.header(four)[5]
    table = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, 5000, 12, 3, 2, 2, 4) + struct.pack(">HHH", 10, 20, 30)
    first = (four + bytes(32) + table).ljust(size, b"\0")
    found = op7.scan(first + 3 * (four + bytes(size - 4)))
    assert found["table"] == {"kind": "VBRI", "bytes": 5000, "frames": 12, "seek": [20, 40, 60], "frames_per_entry": 4} and len(found["frames"]) == 3

    def slow_crc(bits):
        crc = 0xFFFF
        for b in bits:
            crc = ((crc << 1) ^ (0x8005 if (crc >> 15) ^ b else 0)) & 0xFFFF
        return crc

    bits_of = lambda data, n: [data[k >> 3] >> (7 - (k & 7)) & 1 for k in range(n)]
    r = np.random.default_rng(2)
    # layer, header, covered bits: stereo layer I takes 4 bits for each of 2 x 32 subbands; mono layer II at 32 kbit/s and
    # 44.1 kHz takes 2 x 4 + 6 x 3 bits, and 2 for every subband in use.
    for layer, word in ((1, 0xFFFE9000), (2, 0xFFFC10C0)):
        head = word.to_bytes(4)
        size = op7.header(head)[5]
        body = bytes(r.integers(0, 256, size - 6, dtype=np.uint8))
        if layer == 1:
            n = 256
        else:
            alloc, at = [], 0
            for width in (4, 4, 3, 3, 3, 3, 3, 3):
                alloc.append(int("".join(map(str, bits_of(body, 200)[at : at + width])), 2))
                at += width
            n = at + 2 * sum(a > 0 for a in alloc)
        crc = slow_crc(bits_of(head[2:], 16) + bits_of(body, n))
        good = head + crc.to_bytes(2) + body
        hurt = good[:6] + bytes([good[6] ^ 128]) + good[7:]
        assert op7.scan(good * 3)["bad_crc"] == 0 and op7.scan(good + hurt + good)["bad_crc"] == 1
