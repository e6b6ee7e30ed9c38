"""Near-duplicate passages by compact windows.

A text is its sequence of five-word shingles (lower-cased words). Under each of ``HASHES`` hash functions the Cartesian
tree over the shingles' hashes groups all subsequences with the same least hash: a node (l, c, r) stands for every
subsequence from [l, c] to [c, r], and its signature is the hash at c. Only nodes of ``LEAST`` shingles (50 words) or
more are kept, about 2n / LEAST a function; the trees of a block of texts are built together, a level at a time.

Equal texts of a map block are linked to the first, and so are windows with one signature and the same shingles from end
to end; only the first goes on, which meets whatever the others would. Windows that share a signature then meet: all pairs
of up to ``FEW``; of more, at first the neighbours in order of documents, of the shingles that follow the least one, and
of those before it. A signature that a bounded sample of texts (``SAMPLE``) shows to be common is dealt twice for this, by the
shingles next on its right and on its left.

A pair of documents is verified if its windows share signatures of ``ENOUGH`` functions, or one signature and equal
contexts around it of ``STRONG`` segments: the longest stretch of the window intervals whose shingles occur on the other
side, with a Jaccard similarity of ``SIMILARITY`` or more. The slices that the windows span are compared, not the texts.

The neighbours are only a start. Every other pair of windows of a larger group or a common signature is then looked at too
(``rest``), block against block, whatever the group's size. Left out are pairs
without a shortest passage around the least shingle (``LEAST`` shingles in a row, ``MOST`` of which the other has, within
``AROUND`` of it), and pairs of documents that passages have connected, if no such stretch holds a shared shingle that no
passage covers; before any pair is formed, windows without such a stretch of shingles that occur again in the blocks. The others
are verified on these surroundings, whatever the functions; a passage that connects and covers nothing new makes no row. Words without a shared shingle
between two covered stretches may stay out.

``repeated_passages`` has a row for each document, passage and partner that was verified: doc_id, start_word, end_word
(exclusive), partner_id, similarity, and class_id, the smallest doc_id of the documents that passages connect. Which
partners of a class are looked at depends on how the table is cut; what repeats doesn't: ``repeated_stretches`` has a row
for each document and stretch of words that any passage covers, with its class, the class's size, and the class's first
other document, and is meant to be the same however the table is cut, but for the words named above. The query returns these.

Defined results: null and short texts (under 50 words) have no passage; a document without a doc_id can't be named and
is left out; repeats within one document aren't reported; an empty table gives no rows; other columns play no part;
doc_id identifies a document, of rows that share one the largest text is verified. Shingles are compared as 64-bit
hashes for signatures and as their lower 32 bits, within a pair, for verification.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelflow.operators.graph import components

from .common import documents, parts, spread_join, staged_alone as staged

SHINGLE, LEAST, HASHES, ENOUGH, SIMILARITY = 5, 46, 4, 2, 0.8
WINDOWS = "sig long, doc long, cl long, r int, doc2 long, cl2 long, r2 int"
FOUND = "a long, a_start int, a_end int, b long, b_start int, b_end int, similarity double"
DOCS_AT_ONCE, CHARS_AT_ONCE = 1000, 8_000_000
FEW = 8  # windows of a signature that are linked in all pairs at once; larger groups also go to ``rest``
SEGMENTS, SEGMENT, BITS, SENT = 5, 9, 12, 6  # a context: so many segments of so many shingles, each a digest of so many bits; bits sent
STRONG, NEAR = 4, 2  # equal segments that make a link count as enough; segments that deal a common signature
SAMPLE, COMMON, LEAST_COMMON = 2000, 0.01, 32  # texts looked at for common signatures; the share, and number, of them
HELD = 1_000_000  # windows of one signature sorted together; a larger group's neighbours come from overlapping parts
DEALT, LATER = -2, -1  # in place of r2: a window of a common signature; a window for the rest, its signature in doc2
AROUND, MOST, PRINT, BLOCK = 45, 41, 1024, 4096  # the rest: shingles each side, how many of LEAST are shared, bits a window, windows a block
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word, 7)
        return got


_WORDS = _Words()


def shingled(texts: list[str | None], least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """64-bit numbers of the five-word shingles of all texts, joined, and where each text's begin; short texts have none."""
    split = [(t or "").lower().split() for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    joined = np.fromiter((w for words in split for w in map(_WORDS.__getitem__, words)), np.uint64, int(sizes.sum()))
    n = np.where(sizes - SHINGLE + 1 >= least, sizes - SHINGLE + 1, 0)
    starts = np.concatenate([[0], np.cumsum(n)])
    if not starts[-1]:
        return np.empty(0, np.uint64), starts
    at = np.arange(starts[-1]) + np.repeat(np.cumsum(sizes) - sizes - starts[:-1], n)
    h = np.zeros(len(at), np.uint64)
    for k in range(SHINGLE):
        h = _mix(h + joined[at + k] + _U(k + 1))
    return h, starts


def shingles(text: str | None) -> np.ndarray:
    return shingled([text])[0]


def compact_windows(h: np.ndarray, low: np.ndarray, high: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes (l, c, r) of ``least`` or more positions in the Cartesian trees over the stretches [low, high) of ``h``.

    All nodes of a level are found together; r is inclusive. Of equal least values the one nearest the middle is taken.
    """
    some, out = high - low >= least, []
    low, high = low[some], high[some]
    while len(low):
        n = high - low
        begin = np.cumsum(n) - n
        at = np.arange(int(n.sum())) + np.repeat(low - begin, n)
        values = h[at]
        hit = np.flatnonzero(values == np.repeat(np.minimum.reduceat(values, begin), n))
        c = at[hit]
        if len(hit) > len(low):
            node = np.searchsorted(begin, hit, "right") - 1
            off = np.abs(2 * c - low[node] - high[node])
            first = np.searchsorted(node, np.arange(len(low)))
            near = np.flatnonzero(off == np.minimum.reduceat(off, first)[node])
            c = c[near[np.unique(node[near], return_index=True)[1]]]
        out.append((low, c, high - 1))
        low, high = np.concatenate([low, c + 1]), np.concatenate([c, high])
        some = high - low >= least
        low, high = low[some], high[some]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3


def _contexts(sums: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What follows and what precedes the shingles ``at`` within [low, high), the nearest segment in the highest bits."""
    right, left = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    for k in range(SEGMENTS):
        near, far = k * SEGMENT + 1, (k + 1) * SEGMENT + 1
        after = sums[np.minimum(at + far, high)] - sums[np.minimum(at + near, high)]
        before = sums[np.maximum(at + 1 - near, low)] - sums[np.maximum(at + 1 - far, low)]
        right = right << _U(BITS) | _mix(after) >> _U(64 - BITS)
        left = left << _U(BITS) | _mix(before) >> _U(64 - BITS)
    return right, left


def _packed(follows: np.ndarray, precedes: np.ndarray) -> np.ndarray:
    """Both contexts as one number, with ``SENT`` bits a segment."""
    out = np.zeros(len(follows), np.uint64)
    for context in (follows, precedes):
        for k in range(SEGMENTS - 1, -1, -1):
            out = out << _U(SENT) | context >> _U(BITS * k) & _U((1 << SENT) - 1)
    return out.view(np.int64)


_SEEDS = _mix(np.arange(1, HASHES + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


def _nodes(joined: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Signature, whose two lowest bits are the function's number, and place (l, c, r) of every window."""
    sig, places = [], []
    for j in range(HASHES):
        hashes = _mix(joined ^ _SEEDS[j])
        place = compact_windows(hashes, starts[:-1], starts[1:])
        sig.append(hashes[place[1]] & ~_U(3) | _U(j))
        places.append(place)
    return np.concatenate(sig), *(np.concatenate(x) for x in zip(*places, strict=True))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[str]]]:
    """Ids and texts of a bounded number of documents, in order of both."""
    for batch in batches:
        ids, texts, size = [], [], 0
        for doc, text in sorted(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            ids.append(doc)
            texts.append(text)
            size += len(text)
            if len(ids) == DOCS_AT_ONCE or size > CHARS_AT_ONCE:
                yield ids, texts
                ids, texts, size = [], [], 0
        if ids:
            yield ids, texts


def _windows(common: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _blocks(batches):
            joined, starts = shingled(texts)
            keep, same, last = [], [], {}
            for k, doc in enumerate(ids):
                own = joined[starts[k] : starts[k + 1]]
                if len(own):
                    whole = xxhash.xxh128_digest(own.tobytes())
                    if whole not in last:
                        keep.append(k)
                        last[whole] = doc
                    elif last[whole] != doc:
                        same.append((last[whole], doc, len(own)))
            if same:
                one, two, n = np.array(same, np.int64).T
                yield _batch(_mix((two * 31 + one).view(np.uint64)), one, np.zeros_like(one), n - 1, two, np.zeros_like(one), n - 1)
            if not keep:
                continue
            if len(keep) < len(ids):
                joined = np.concatenate([joined[starts[k] : starts[k + 1]] for k in keep])
                starts = np.concatenate([[0], np.cumsum(np.diff(starts)[keep])])
            sig, l, c, r = _nodes(joined, starts)  # noqa: E741
            nth = np.searchsorted(starts, c, "right") - 1
            doc, begin = np.array(ids, np.int64)[keep][nth], starts[nth]
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(joined))])
            follows, precedes = _contexts(sums, c, begin, starts[nth + 1])
            inside = _mix(sums[r + 1] - sums[c]) ^ (sums[c] - sums[l])
            cl, r = (c - begin) << 32 | (l - begin), r - begin
            _, first, which = np.unique(_mix(_mix(_mix(sig ^ _mix(follows)) ^ precedes) ^ inside), return_index=True, return_inverse=True)
            other = np.flatnonzero(doc[first[which]] != doc)
            if len(other):  # the same from end to end: linked to the first
                i = first[which[other]]
                yield _batch(_mix(sig[other] ^ doc[other].view(np.uint64)), doc[i], cl[i], r[i], doc[other], cl[other], r[other])
            some = np.sort(first)
            hot = np.isin(sig[some], common)
            plain, hot = some[~hot], some[hot]
            around = _packed(follows, precedes)
            yield _batch(sig[plain], doc[plain], cl[plain], r[plain], around[plain])
            for context, side in ((follows, 1), (precedes, 2)) if len(hot) else ():
                near = _mix((context[hot] >> _U(BITS * (SEGMENTS - NEAR))) << _U(2) | _U(side))
                dealt = _mix(sig[hot] ^ near) & ~_U(3) | sig[hot] & _U(3)
                yield _batch(dealt, doc[hot], cl[hot], r[hot], around[hot], None, np.full(len(hot), DEALT))
            if len(hot):
                yield _later(_mix(sig[hot] ^ doc[hot].view(np.uint64)), sig[hot].view(np.int64), doc[hot], cl[hot], r[hot])

    return run


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, texts in _blocks(batches):
        joined, starts = shingled(texts)
        if len(joined):
            sig, _, c, _ = _nodes(joined, starts)
            nth = np.searchsorted(starts, c, "right")
            pairs = np.unique(np.stack([sig.view(np.int64), nth]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0])], names=["sig"])


def common_signatures(named: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Signatures that more than a share of a bounded sample of texts holds. They only decide where windows meet."""
    some = F.broadcast(named.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).distinct())
    held = named.join(some, "doc_id", "left_semi").limit(2 * sample).mapInArrow(_signatures, "sig long").groupBy("sig").count()
    got = held.where(F.col("count") >= max(LEAST_COMMON, int(COMMON * sample))).select("sig").collect()
    return np.array(sorted(r.sig for r in got), np.int64).view(np.uint64)


def _batch(sig, doc, cl, r, doc2, cl2=None, r2=None) -> pa.RecordBatch:
    """Links; or windows, which have no r2 (``DEALT``, for common signatures), no cl2, and their contexts in place of doc2."""
    return pa.RecordBatch.from_arrays([
        pa.array(sig.view(np.int64)), pa.array(doc, pa.int64()), pa.array(cl, pa.int64()), pa.array(r.astype(np.int32)),
        pa.array(doc2, pa.int64()), pa.nulls(len(sig), pa.int64()) if cl2 is None else pa.array(cl2, pa.int64()), pa.nulls(len(sig), pa.int32()) if r2 is None else pa.array(r2.astype(np.int32)),
    ], names=["sig", "doc", "cl", "r", "doc2", "cl2", "r2"])


def _later(at, sig, doc, cl, r) -> pa.RecordBatch:
    """Windows for ``rest``; ``at`` only spreads them."""
    return _batch(at, doc, cl, r, sig, None, np.full(len(sig), LATER))


ALL = (1 << HASHES + 1) - 1


def _alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many segments of two contexts are equal before the first that isn't."""
    apart = (x ^ y).view(np.uint64)
    return sum((apart < _U(1 << SENT * k)).astype(np.int8) for k in range(SEGMENTS))


def _links(sig, doc, cl, r, contexts, dealt, part_of: int | None = None) -> Iterator[pa.RecordBatch]:
    """Links of windows that share a signature, and the windows of more than ``FEW``, for ``rest``.

    Whole groups come in, sorted by signature and what follows; or a further part of the group ``part_of``, whose first
    window ended the part before. A link's sig is the set of functions that speak for it, and one bit more if the
    contexts alone are enough.
    """
    n, follows, precedes = len(sig), *np.divmod(contexts, 1 << SENT * SEGMENTS)
    new = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if n else np.empty(0, np.int64)
    sizes = np.diff(np.append(new, n))
    size, pairs = np.repeat(sizes, sizes), []
    goes_on = n > 0 and part_of == sig[0]
    if goes_on:
        size[: sizes[0]] = FEW + n
    for d in range(1, FEW):  # all pairs of small groups, neighbours of the others
        i = np.flatnonzero((sig[d:] == sig[:-d]) & ((size[d:] <= FEW) | (d == 1)))
        pairs.append((i, i + d))
    many = np.flatnonzero(size > FEW)
    for order in (doc, precedes):
        order = many[np.lexsort((many, order[many], sig[many]))]
        i, j = order[:-1], order[1:]
        beside = sig[i] == sig[j]
        pairs.append((np.minimum(i, j)[beside], np.maximum(i, j)[beside]))
    i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
    i, j = np.divmod(np.unique(i * n + j), n) if n else (i, j)
    other = doc[i] != doc[j]
    i, j = i[other], j[other]
    strong = _alike(follows[i], follows[j]) + _alike(precedes[i], precedes[j]) >= STRONG
    functions = np.left_shift(1, sig[i] & 3) | strong * (1 << HASHES)
    yield _batch(functions, doc[i], cl[i], r[i], doc[j], cl[j], r[j])
    many = many[1:] if goes_on else many
    many = many[~dealt[many]]
    yield _later(np.full(len(many), ALL), sig[many], doc[many], cl[many], r[many])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted windows of all tasks to links and the windows of larger groups; links that come in go out."""
    held: list[list[np.ndarray]] = []  # windows from the last group's start on
    part_of = None
    for batch in batches:
        kind = pc.fill_null(batch.column("r2"), DEALT - 1)
        old = batch.filter(pc.greater(kind, DEALT))
        if old.num_rows:
            yield old.set_column(0, "sig", pa.array(np.full(old.num_rows, ALL)))
        new = batch.filter(pc.less_equal(kind, DEALT))
        if not new.num_rows:
            continue
        columns = [new.column(k).to_numpy() for k in range(5)] + [new.column("r2").is_valid().to_numpy(zero_copy_only=False)]
        cut = int(np.searchsorted(columns[0], columns[0][-1]))
        if cut or (held and held[-1][0][-1] != columns[0][0]):
            yield from _links(*(np.concatenate(x) for x in zip(*held, [c[:cut] for c in columns], strict=True)), part_of)
            held, part_of = [], None
        held.append([c[cut:] for c in columns])
        if sum(len(h[0]) for h in held) > HELD:
            yield from _links(*(np.concatenate(x) for x in zip(*held, strict=True)), columns[0][-1] if part_of is None else part_of)
            held, part_of = [[c[-1:] for c in columns]], columns[0][-1]
    if held:
        yield from _links(*(np.concatenate(x) for x in zip(*held, strict=True)), part_of)


def meetings(docs: DataFrame) -> DataFrame:
    """Links between windows, and (r2 ``LATER``) the windows of common signatures and of those that more than ``FEW`` share."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    windows = named.mapInArrow(_windows(common_signatures(named)), WINDOWS).repartition(parts(docs.sparkSession), "sig").sortWithinPartitions("sig", "doc2", "doc")
    return windows.mapInArrow(_met, WINDOWS)


def candidate_pairs(met: DataFrame, enough: int = ENOUGH) -> DataFrame:
    """(a, b, windows): documents whose windows share signatures of ``enough`` functions, or a signature and its contexts."""
    one, two = F.struct("cl", "r"), F.struct(F.col("cl2").alias("cl"), F.col("r2").alias("r"))
    turned = F.col("doc") > F.col("doc2")
    left, right = F.when(turned, two).otherwise(one), F.when(turned, one).otherwise(two)
    pairs = met.where(F.col("r2") > LATER).select(
        F.least("doc", "doc2").alias("a"), F.greatest("doc", "doc2").alias("b"), F.col("sig").cast("int").alias("functions"),
        F.struct(left.cl.alias("acl"), left.r.alias("ar"), right.cl.alias("bcl"), right.r.alias("br")).alias("window"),
    )
    grouped = pairs.groupBy("a", "b").agg(F.bit_or("functions").alias("functions"), F.collect_list("window").alias("windows"))
    return grouped.where(F.bit_count("functions") >= enough).drop("functions")


def _bare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which of the shingles around the least one of a window no span of covered words holds, as bits in place of ``spans``."""
    width = 2 * AROUND + 1
    for batch in batches:
        spans, low = batch.column("spans"), batch.column("low").to_numpy()
        sizes = np.diff(spans.offsets.to_numpy())
        row = np.repeat(np.arange(batch.num_rows), sizes)
        flat = spans.flatten()
        begin, end = (np.clip(flat.field(k).to_numpy() - less - low[row], 0, width) for k, less in ((0, 0), (1, SHINGLE - 1)))
        some = begin < end
        steps = np.zeros((batch.num_rows, width + 1), np.int32)
        np.add.at(steps, (row[some], begin[some]), 1)
        np.add.at(steps, (row[some], end[some]), -1)
        bits = np.packbits(np.cumsum(steps[:, :width], axis=1) == 0, axis=1)
        out = batch.drop_columns(["spans"])
        yield out.append_column("bare", pa.array([b.tobytes() for b in bits], pa.binary()))


def _matrix(values: np.ndarray, row: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    out = np.full((n, 2 * AROUND + 1), -1, np.int64)
    out[row, at] = values
    return out


def _held(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which numbers of each row of x occur in the same row of y, whose rows are sorted; -1 stands for none."""
    step = np.arange(len(x))[:, None] * (int(x.max()) + int(y.max()) + 3)
    asked, there = (x + step).ravel(), (y + step).ravel()
    return (there[np.minimum(np.searchsorted(there, asked), len(there) - 1)] == asked).reshape(x.shape) & (x >= 0)


def _long(flags: np.ndarray) -> np.ndarray:
    """Where ``LEAST`` places in a row begin, ``MOST`` of which are set, in rows whose flags reach as far at all."""
    held = np.cumsum(flags, axis=1, dtype=np.uint8)
    long = held[:, LEAST - 1 :] - held[:, : -LEAST + 1] + flags[:, : -LEAST + 1] >= MOST
    reach = flags.shape[1] - np.argmax(flags[:, ::-1], axis=1) - np.argmax(flags, axis=1)
    return long & (reach >= LEAST)[:, None]


def _with(long: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Which rows have such places with a flag among them."""
    held = np.cumsum(flags, axis=1, dtype=np.uint8)
    return (long & (held[:, LEAST - 1 :] - held[:, : -LEAST + 1] + flags[:, : -LEAST + 1] > 0)).any(axis=1)


def _longest(flags: np.ndarray, sizes: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """``longest`` of each row's first ``sizes`` flags."""
    upto = np.arange(flags.shape[1] + 1)
    sums = np.zeros((len(flags), len(upto)))
    np.cumsum(flags - share, axis=1, out=sums[:, 1:])
    sums += 1e-9 * upto
    low = np.minimum.accumulate(sums, axis=1)
    start = np.count_nonzero(low[:, None, :] > sums[:, :, None], axis=2)
    best = np.argmax(np.where(upto <= sizes[:, None], upto - start, -1), axis=1)
    own = flags & _between(start[np.arange(len(flags)), best], best, flags.shape[1])
    some = own.any(axis=1)
    return np.argmax(own, axis=1) * some, (flags.shape[1] - np.argmax(own[:, ::-1], axis=1)) * some


def _between(low: np.ndarray, high: np.ndarray, width: int) -> np.ndarray:
    at = np.arange(width)
    return (at >= low[:, None]) & (at < high[:, None])


def _passage_rows(x: np.ndarray, y: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, ...]:
    """``_passage`` of each row of x and y, of which ``flags`` says what of x is in y: which have one, its places, similarity."""
    share, width = 2 * SIMILARITY / (1 + SIMILARITY), x.shape[1]
    i, j = _longest(flags, (x >= 0).sum(axis=1), share)
    which = np.flatnonzero(j - i >= LEAST)
    x, y, i, j = x[which], y[which], i[which], j[which]
    if not len(which):
        return which, i, j, i, j, np.empty(0)
    left = np.sort(np.where(_between(i, j, width), x, -1), axis=1)
    k, m = _longest(_held(y, left), (y >= 0).sum(axis=1), share)
    right = np.sort(np.where(_between(k, m, width), y, -1), axis=1)
    one, two = (np.diff(z, axis=1, prepend=-1) > 0 for z in (left, right))
    both = (one & _held(left, right)).sum(axis=1)
    alike = both / np.maximum(one.sum(axis=1) + two.sum(axis=1) - both, 1)
    ok = (m - k >= LEAST) & (alike >= SIMILARITY)
    return which[ok], i[ok], j[ok], k[ok], m[ok], alike[ok]


def _block_links(one: int, two: int, doc, first, group, block, numbers, shared, bare) -> Iterator[tuple]:
    """Passages between windows of two blocks, or of one, of a signature that connect documents or cover more of one.

    ``numbers`` are the windows' shingles, ``shared`` those that occur again in the blocks, ``bare`` what nothing covers.
    """
    n, group, bare, width = len(doc), group.copy(), bare.copy(), numbers.shape[1]
    base, last = (int(f(numbers[shared])) for f in (np.min, np.max))
    local = np.where(shared, numbers - base, last - base + 1)
    row, at = np.nonzero(shared)
    bits = np.zeros((n, PRINT), bool)
    bits[row, local[row, at] % PRINT] = True
    prints = np.packbits(bits, axis=1).view(np.uint64)
    least = MOST - (shared.sum(axis=1) - bits.sum(axis=1))
    mine, theirs = (np.flatnonzero(block == k) for k in (one, two))
    columns = np.ascontiguousarray(prints[theirs].T)
    reached = _long(shared)
    some = _with(reached, bare & shared)
    for low in range(0, len(mine), 64):
        i = mine[low : low + 64]
        asked = (doc[i, None] != doc[theirs]) & ((group[i, None] != group[theirs]) | some[i, None] | some[theirs])
        if one == two:
            asked &= i[:, None] < theirs
        if not asked.any():
            continue
        common = np.zeros((len(i), len(theirs)), np.uint8)
        for k, column in enumerate(columns):
            common += np.bitwise_count(prints[i, k, None] & column)
        x, y = np.nonzero(asked & (common >= least[i, None]) & (common >= least[theirs]))
        y, place = theirs[y], np.full((len(i), last - base + 2), width, np.int8)
        nth = np.arange(len(i))[:, None]
        place[nth, local[i, ::-1]] = np.arange(width - 1, -1, -1)  # of equal ones the first stays
        place[:, -1] = width
        first_of = place[nth, local[i]]
        part, size = 0, 32
        while part < len(x):
            u, q = x[part : part + size], y[part : part + size]
            p, part, size = i[u], part + size, min(2 * size, 1024)
            open_ = (group[p] != group[q]) | some[p] | some[q]
            u, p, q = u[open_], p[open_], q[open_]
            if not len(p):
                continue
            there = place[u[:, None], local[q]]
            in_q, marks = there < width, np.zeros((len(p), width + 1), bool)
            marks[np.arange(len(p))[:, None], there] = True
            marks[:, width] = False
            in_p = marks[np.arange(len(p))[:, None], first_of[u]]
            long, other = _long(in_p), _long(in_q)
            ok = long.any(axis=1) & other.any(axis=1) & ((group[p] != group[q]) | _with(long, in_p & bare[p]) | _with(other, in_q & bare[q]))
            p, q, in_p = p[ok], q[ok], in_p[ok]
            if not len(p):
                continue
            which, *places, alike = _passage_rows(numbers[p], numbers[q], in_p)
            for a, b, x0, x1, y0, y1, s in zip(p[which].tolist(), q[which].tolist(), *(z.tolist() for z in places), alike.tolist(), strict=True):
                apart = group[a] != group[b]
                if not apart and not bare[a, x0:x1].any() and not bare[b, y0:y1].any():
                    continue
                bare[a, x0:x1] = bare[b, y0:y1] = False
                some[[a, b]] = _with(reached[[a, b]], bare[[a, b]] & shared[[a, b]])
                if apart:
                    group[group == max(group[a], group[b])] = min(group[a], group[b])
                yield doc[a], first[a] + x0, first[a] + x1 + SHINGLE - 1, doc[b], first[b] + y0, first[b] + y1 + SHINGLE - 1, s


def _groups_links(key: np.ndarray, one, two, doc, first, group, block, around, bare) -> Iterator[tuple]:
    """``_block_links`` of all groups of equal ``key``; only windows with a shortest passage of shingles that others have go on."""
    n = len(doc)
    sizes = np.fromiter(map(len, around), np.int64, n) // 4
    row = np.repeat(np.arange(n), sizes)
    at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    values = np.frombuffer(b"".join(around), "<u4").astype(np.int64)
    _, which, times = np.unique(key[row] << 32 | values, return_inverse=True, return_counts=True)
    often = times > 1
    numbers = _matrix(np.where(often, np.cumsum(often) - 1, len(times) + np.arange(len(times)))[which], row, at, n)
    shared = (numbers >= 0) & (numbers < len(times))
    bare = (np.unpackbits(np.frombuffer(b"".join(bare), np.uint8).reshape(n, -1), axis=1)[:, : numbers.shape[1]] > 0) & (numbers >= 0)
    long = _long(shared)
    keep = np.flatnonzero(long.any(axis=1))
    some = _with(long, bare & shared)
    ends = np.searchsorted(key[keep], np.arange(key[-1] + 2))
    for low, high in zip(ends, ends[1:]):
        own = keep[low:high]
        if len(own) > 1 and ((group[own] != group[own[0]]).any() or some[own].any()):
            yield from _block_links(one[own[0]], two[own[0]], doc[own], first[own], group[own], block[own], numbers[own], shared[own], bare[own])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows sorted by signature and pair of blocks to passages; at most two blocks and a batch are held."""
    held: list[list[np.ndarray]] = []  # windows from the last group's start on

    def done(columns: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        sig, *cols = (np.concatenate(x) for x in zip(*columns, strict=True))
        if len(sig):
            key = np.cumsum(np.concatenate([[0], (np.diff(sig) != 0) | (np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0)]))
            rows = list(_groups_links(key, *cols))
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["a", "a_start", "a_end", "b", "b_start", "b_end", "similarity"])

    for batch in batches:
        if batch.num_rows:
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(9)]
            last = np.flatnonzero((columns[0] != columns[0][-1]) | (columns[1] != columns[1][-1]) | (columns[2] != columns[2][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if held and (cut or any(h[-1] != c[0] for h, c in zip(held[0][:3], columns, strict=False))):
                yield from done([*held, [c[:cut] for c in columns]])
                held = []
            elif cut:
                yield from done([[c[:cut] for c in columns]])
            held.append([c[cut:] for c in columns])
    if held:
        yield from done(held)


def rest(met: DataFrame, found: DataFrame, numbers: DataFrame) -> DataFrame:
    """What all pairs of windows of the larger groups add to what the passages ``found`` cover and connect."""
    spans = merged_stretches(classified(found)).groupBy("doc_id").agg(F.first("class_id").alias("class_id"), F.collect_list(F.struct("start_word", "end_word")).alias("spans"))
    windows = met.where(F.col("r2") == LATER).select(F.col("doc2").alias("sig"), F.col("doc").alias("doc_id"), "cl", "r", F.col("cl").bitwiseAND(0xFFFFFFFF).cast("int").alias("l"), F.shiftright("cl", 32).cast("int").alias("c"))
    covered = F.exists("spans", lambda s: (s.start_word <= F.col("l")) & (s.end_word >= F.col("r") + SHINGLE))
    low, high = F.greatest("l", F.col("c") - AROUND), F.least("r", F.col("c") + AROUND) + SHINGLE
    near = F.filter(F.coalesce("spans", F.array()), lambda s: (s.start_word < high) & (s.end_word > F.col("low")))
    known = staged(windows.withColumn("low", low).join(spans, "doc_id", "left").select(
        "sig", "doc_id", "c", "r", "low", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce(covered, F.lit(False)).alias("settled"), near.alias("spans")))
    groups = known.groupBy("sig").agg(F.count("*").alias("n"), (F.min("settled") & (F.min("class_id") == F.max("class_id"))).alias("done"))
    blocks = groups.where("not done").select("sig", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    open_ = spread_join(known, blocks, "sig", "doc_id").where("blocks is not null")
    around = F.substring("shingles", 4 * F.col("low") + 1, 4 * (F.least("r", F.col("c") + AROUND) - F.col("low") + 1))
    printed = open_.join(numbers.withColumnRenamed("id", "doc_id"), "doc_id").withColumn("around", around).where("length(around) > 0")
    printed = printed.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).select("sig", "doc_id", "low", "class_id", "block", "blocks", "around", "spans")
    printed = printed.mapInArrow(_bare, "sig long, doc_id long, low int, class_id long, block int, blocks int, around binary, bare binary")
    dealt = printed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("sig", F.least("block", "with").alias("one"), F.greatest("block", "with").alias("two"), "doc_id", "low", "class_id", "block", "around", "bare")
    dealt = dealt.repartition(parts(met.sparkSession), "sig", "one", "two").sortWithinPartitions("sig", "one", "two")
    return dealt.mapInArrow(_compared, FOUND)


def longest(flags: np.ndarray, share: float) -> tuple[int, int]:
    """The longest stretch in which at least ``share`` of the flags are set, cut to its first and last flag."""
    sums = np.concatenate([[0.0], np.cumsum(flags - share)]) + 1e-9 * np.arange(len(flags) + 1)
    low = np.minimum.accumulate(sums)
    start = np.searchsorted(-low, -sums)
    best = int(np.argmax(np.arange(len(sums)) - start))
    i, j = int(start[best]), best
    own = np.flatnonzero(flags[i:j])
    return (i + int(own[0]), i + int(own[-1]) + 1) if len(own) else (0, 0)


def _within(a: np.ndarray, b: np.ndarray, numbers: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``a`` occur in ``b``, both of numbers below ``numbers``; and b as a set of flags."""
    held = np.zeros(numbers, bool)
    held[b] = True
    return held[a], held


def _near(flags: np.ndarray, share: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of flags; and of places where ``2 * least`` less one hold enough for ``least``: a longer stretch has a part that does."""
    sums = np.concatenate([[0], np.cumsum(flags)])
    ends = np.minimum(np.arange(len(flags)) + 2 * least - 1, len(flags))
    return sums, np.concatenate([[0], np.cumsum(sums[ends] - sums[:-1] >= share * least - 1e-6)])


def verify(a: np.ndarray, b: np.ndarray, windows: np.ndarray, similarity: float = SIMILARITY, least: int = LEAST) -> list[tuple[int, int, int, int, float]]:
    """Passages (a's start and end, b's start and end, Jaccard) among window pairs (l, c, r of a, then of b), in shingles."""
    out, share = [], 2 * similarity / (1 + similarity)
    windows = windows[(windows[:, 2] < len(a)) & (windows[:, 5] < len(b))]
    if not len(windows):
        return out
    if len(a) == len(b) and len(a) >= least and (a == b).all():
        return [(0, len(a), 0, len(b), 1.0)]
    ranks = np.unique(np.concatenate([a, b]), return_inverse=True)[1]
    a, b, numbers, none = ranks[: len(a)], ranks[len(a) :], int(ranks.max()) + 1, set()
    for first, flags in ((0, _within(a, b, numbers)[0]), (3, _within(b, a, numbers)[0])):
        low, high = windows[:, first], windows[:, first + 2] + 1
        sums, near = _near(flags, share, least)
        windows = windows[(sums[high] - sums[low] >= share * least) & (near[np.maximum(high - least + 1, low)] > near[low])]
        if not len(windows):
            return out
    windows = windows[np.argsort(-np.minimum(windows[:, 2] - windows[:, 0], windows[:, 5] - windows[:, 3]), kind="stable")]
    while len(windows):
        la, _, ra, lb, _, rb = windows[0].tolist()
        windows = windows[1:]
        if (la, ra, lb, rb) in none:
            continue
        found = _passage(a[la : ra + 1], b[lb : rb + 1], numbers, share, similarity, least)
        if found:
            i, j, x, y, s = found
            i, j, x, y = la + i, la + j, lb + x, lb + y
            out.append((i, j, x, y, s))
            windows = windows[(windows[:, 1] < i) | (windows[:, 1] >= j) | (windows[:, 4] < x) | (windows[:, 4] >= y)]
        else:
            none.add((la, ra, lb, rb))
    return out


def _passage(own: np.ndarray, other: np.ndarray, numbers: int, share: float, similarity: float, least: int) -> tuple[int, int, int, int, float] | None:
    flags = _within(own, other, numbers)[0]
    i, j = longest(flags, share) if np.count_nonzero(flags) >= share * least else (0, 0)
    if j - i < least:
        return None
    flags, left = _within(other, own[i:j], numbers)
    x, y = longest(flags, share)
    if y - x < least:
        return None
    right = _within(own[:0], other[x:y], numbers)[1]
    found = np.count_nonzero(left & right) / np.count_nonzero(left | right)
    return (i, j, x, y, found) if found >= similarity else None


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        windows, rows = batch.column("windows"), []
        first, fields = windows.offsets.to_numpy(), windows.values
        acl, ar, bcl, br = (fields.field(k).to_numpy() for k in range(4))
        low = 0xFFFFFFFF
        every = np.stack([acl & low, acl >> 32, ar, bcl & low, bcl >> 32, br], axis=1)
        a, b, from_a, from_b, one, two = (batch.column(k) for k in ("a", "b", "from_a", "from_b", "of_a", "of_b"))
        for k in range(batch.num_rows):
            p, q = from_a[k].as_py(), from_b[k].as_py()
            own = every[first[k] : first[k + 1]] - np.array([p, p, p, q, q, q])
            found = verify(np.frombuffer(one[k].as_buffer(), "<u4"), np.frombuffer(two[k].as_buffer(), "<u4"), own)
            rows += [(a[k].as_py(), p + i, p + j + SHINGLE - 1, b[k].as_py(), q + x, q + y + SHINGLE - 1, s) for i, j, x, y, s in found]
        columns = list(zip(*rows, strict=True)) or [()] * 7
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["a", "a_start", "a_end", "b", "b_start", "b_end", "similarity"])


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, lower halves of the shingles' numbers)."""
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            some = batch.slice(at, 200)
            joined, starts = shingled(some.column(1).to_pylist())
            raw = joined.astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array([raw[4 * i : 4 * j] for i, j in zip(starts, starts[1:])], pa.binary())], names=["id", "shingles"])


def passages(pairs: DataFrame, numbers: DataFrame) -> DataFrame:
    """The passages of ``pairs``, verified on the slices of their shingles that their windows span."""
    asked = pairs
    for side in "ab":
        low = F.array_min(F.transform("windows", lambda w: w[f"{side}cl"].bitwiseAND(0xFFFFFFFF))).cast("int")  # noqa: B023
        asked = asked.withColumn(f"from_{side}", low).withColumn(f"to_{side}", F.array_max(F.transform("windows", lambda w: w[f"{side}r"])))  # noqa: B023
    for side in "ab":
        cut = F.expr(f"substring(shingles, 4 * from_{side} + 1, 4 * (to_{side} - from_{side} + 1))")
        asked = asked.join(numbers.withColumnRenamed("id", side), side).withColumn(f"of_{side}", cut).drop("shingles", f"to_{side}")
    return staged(asked.mapInArrow(_verified, FOUND))


def classified(found: DataFrame) -> DataFrame:
    """Both sides of every passage, with the class that passages connect."""
    classes = components(found.select("a", "b").distinct())
    sides = found.select(F.col("a").alias("doc_id"), F.col("a_start").alias("start_word"), F.col("a_end").alias("end_word"), F.col("b").alias("partner_id"), "similarity").unionAll(
        found.select("b", "b_start", "b_end", "a", "similarity"))
    classes = classes.select(F.col("node").alias("doc_id"), F.col("component").alias("class_id"))
    return sides.join(classes, "doc_id", "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))


def merged_stretches(sides: DataFrame) -> DataFrame:
    """doc_id, start_word, end_word, class_id: the stretches of words that any passage covers."""
    found = sides.groupBy("doc_id", "start_word", "end_word").agg(F.first("class_id").alias("class_id"))
    order = Window.partitionBy("doc_id").orderBy("start_word", "end_word")
    upto = F.max("end_word").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begun = found.withColumn("new", F.when(F.col("start_word") <= upto, 0).otherwise(1)).withColumn("stretch", F.sum("new").over(order))
    return begun.groupBy("doc_id", "stretch").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"), F.first("class_id").alias("class_id")).drop("stretch")


def repeated_passages(docs: DataFrame) -> DataFrame:
    met = staged(meetings(docs))
    pairs = staged(candidate_pairs(met))
    named = pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")).unionAll(met.where(F.col("r2") == LATER).select("doc")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("text is not null").join(named, "id", "left_semi")
    numbers = staged(texts.groupBy("id").agg(F.max("text").alias("text")).mapInArrow(_numbers, "id long, shingles binary"))
    found = passages(pairs, numbers)
    return classified(staged(found.unionAll(rest(met, found, numbers))))


def repeated_stretches(docs: DataFrame) -> DataFrame:
    """doc_id, start_word, end_word, class_id, class_size and partner_id, the smallest other doc_id of the class."""
    merged = staged(merged_stretches(repeated_passages(docs)))
    members = merged.groupBy("class_id", "doc_id").agg(F.lit(1).alias("one"))
    sizes = members.groupBy("class_id").agg(F.count("*").alias("class_size"), F.min(F.when(F.col("doc_id") != F.col("class_id"), F.col("doc_id"))).alias("second"))
    rows = spread_join(merged, staged(sizes), "class_id", "doc_id", salts=128)
    return rows.select("doc_id", "start_word", "end_word", "class_id", "class_size", F.when(F.col("doc_id") == F.col("class_id"), F.col("second")).otherwise(F.col("class_id")).alias("partner_id"))


def op9_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_stretches(documents(spark, sf_dir))
