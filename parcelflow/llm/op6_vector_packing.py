"""Best-fit packing of tokenised documents into sequences under several capacities.

Documents longer than a sequence are cut into whole-sequence pieces; a last piece and shorter documents stay whole. A
piece asks for (tokens, one document, attention cost = length squared). Pieces are dealt evenly over packing groups;
inside a group they come in decreasing length, and a piece goes to the open sequence that satisfies every capacity and
has the largest weighted dot product of its demand with the sequence's residuals (``rule="dot"``), or leaves the smallest
weighted residual norm (``rule="norm"``, the default: it fills sequences tightest). Each group ends with at most a few
sequences open, so the loss against one global packing is about one sequence a group.

Defined results: a null text is empty and yields one piece, the end id alone; repeated rows are packed each on its own;
a null doc_id stays null; an empty table gives no rows; other columns play no part. Ties go to the sequence opened first.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, staged

LENGTH, END_ID = 2048, 0
WEIGHTS = (1.0, 0.01, 0.1)  # of tokens, documents and attention cost
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"
PIECES_A_GROUP = 8_000

# Words of these characters can be encoded one by one: white space ends a word in the tokenizer as in str.split, and
# lower-casing and composition don't reach beyond a word.
_ODD = re.compile("[^\t-\r -~¡-ſ]|<\\|")
_ODD_SPACES = "\x1c\x1d\x1e\x1f"
_TAIL = ".,;:!?*#%$&)\"'"


def _plain(text: str) -> bool:
    """Whether the text can be encoded word by word."""
    if "<|" in text or any(c in text for c in _ODD_SPACES):
        return False
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return not _ODD.search(text)


class WordIds:
    """Ids, as bytes, of white-space separated words; a word is encoded once while it is remembered.

    Two generations of at most ``most`` words bound the memory.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.plain = Tokenizer.from_file(path)  # for lower-case letters only: nothing to normalise or to split but spaces
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        size = self.whole.get_vocab_size()
        self.ends = np.zeros(size, bool)
        for token, k in self.whole.get_vocab().items():
            self.ends[k] = token.endswith("</w>")
        self.now, self.old, self.most, self.tails = {}, {}, most, {}

    def encode(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: set[str]) -> None:
        if len(self.now) > self.most:
            self.now, self.old = {}, self.now
        now = self.now
        found, old, cores, rest = [], self.old.get, {}, []
        for w in words:
            if (got := old(w)) is not None:
                now[w] = got
                continue
            core = w.rstrip(_TAIL)
            if core.isalpha():
                found.append((w, cores.setdefault(core, len(cores)), w[len(core) :]))
            else:
                rest.append(w)
        plain = list(cores)
        lists = [" ".join(plain[k : k + 50]) for k in range(0, len(plain), 50)]
        if lists:
            ids = np.concatenate([np.array(x.ids, "<u4") for x in self.plain.encode_batch_fast(lists, add_special_tokens=False)])
            ends = [0, *(4 * np.flatnonzero(self.ends[ids]) + 4).tolist()]
            if len(ends) != len(plain) + 1:
                raise ValueError("the vocabulary doesn't mark the ends of words")
            raw, tail_of = ids.tobytes(), self._tail
            for w, k, tail in found:
                now[w] = raw[ends[k] : ends[k + 1]] + tail_of(tail) if tail else raw[ends[k] : ends[k + 1]]
        for w in rest:
            now[w] = self.encode(w)

    def _tail(self, tail: str) -> bytes:
        if tail not in self.tails:
            # A quote may bind letters that follow it, never those before it, so a tail stands alone.
            self.tails[tail] = self.encode(tail) if tail else b""
        return self.tails[tail]

    def batch(self, texts: list[str]) -> Iterator[bytes]:
        rows, missing, get = [], set(), self.now.get
        for text in texts:
            if not _plain(text):
                rows.append((self.encode(text), None, None))
                continue
            words = text.lower().split()
            ids = list(map(get, words))
            gaps = [k for k, x in enumerate(ids) if x is None] if None in ids else ()
            if gaps:
                words = [words[k] for k in gaps]
                missing.update(words)
                rows.append((ids, gaps, words))
            else:
                rows.append((b"".join(ids), None, None))
        if missing:
            self.learn(missing)
        now = self.now
        for ids, gaps, words in rows:
            if gaps is None:
                yield ids
            else:
                for k, w in zip(gaps, words, strict=True):
                    ids[k] = now[w]
                yield b"".join(ids)


_LOADED: dict[str, WordIds] = {}


def tokenise(path: str, length: int = LENGTH):
    """Arrow batches of (doc_id, text) to batches of pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _LOADED:
            _LOADED[path] = WordIds(path)
        ids_of, end = _LOADED[path], np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                rows = []
                for doc, ids in zip(some.column(0).to_pylist(), ids_of.batch([t or "" for t in some.column(1).to_pylist()]), strict=True):
                    ids += end
                    for k, start in enumerate(range(0, len(ids), 4 * length)):
                        part = ids[start : start + 4 * length]
                        rows.append((doc, k, start // 4, len(part) // 4, zlib.crc32(part)))
                columns = list(zip(*rows, strict=True)) or [()] * 5
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def assign(lengths: np.ndarray, length: int = LENGTH, most_docs: int = LENGTH, most_cost: float = float(LENGTH) ** 2, weights=WEIGHTS, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of every piece."""
    capacity = np.array([length, most_docs, most_cost], float)
    w = np.array(weights)[:, None]
    sequence, offset = np.empty(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room = np.empty((3, max(1, len(lengths))))  # residual share of each capacity, open sequences first in use
    number = np.empty(max(1, len(lengths)), np.int64)
    used, opened = 0, 0
    order = np.argsort(-lengths, kind="stable")
    least = lengths.min() if len(lengths) else 0
    for i in order:
        n = int(lengths[i])
        need = np.array([n, 1.0, float(n) * n]) / capacity
        if need.max() > 1 + 1e-12:
            raise ValueError("a piece exceeds a capacity")
        best = -1
        if used:
            r = room[:, :used]
            fits = (r >= need[:, None] - 1e-12).all(axis=0)
            if fits.any():
                score = (w * need[:, None] * r).sum(axis=0) if rule == "dot" else -(w * (r - need[:, None]) ** 2).sum(axis=0)
                score[~fits] = -np.inf
                best = int(np.flatnonzero(score == score.max())[np.argmin(number[:used][score == score.max()])])
        if best < 0:
            best, used = used, used + 1
            room[:, best], number[best] = 1.0, opened
            opened += 1
        sequence[i], offset[i] = number[best], round((1 - room[0, best]) * length)
        room[:, best] -= need
        if room[0, best] * length < least - 1e-6 or (room[1:, best] <= 1e-12).any():  # full: make room in the list
            used -= 1
            room[:, best], number[best] = room[:, used], number[used]
    return sequence, offset


def _pack(**how):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        table = table.take(pc.sort_indices(table, [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")]))
        sequence, offset = assign(table.column("length").to_numpy(), **how)
        table = table.append_column("sequence_id", pa.array(sequence + (TaskContext.get().partitionId() << 36))).append_column("offset", pa.array(offset))
        yield from table.to_batches(10_000)

    return run


def pieces_of(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tokenise(path, length), PIECES)


def pack(
    docs: DataFrame, path: str | None = None, length: int = LENGTH, rule: str = "norm", pieces_a_group: int = PIECES_A_GROUP,
    most_docs: int | None = None, most_cost: float | None = None, weights: tuple[float, float, float] = WEIGHTS,
) -> DataFrame:
    """One row per piece with its sequence and its place there.

    A sequence holds at most ``length`` tokens, ``most_docs`` pieces and ``most_cost`` of the pieces' squared lengths; left
    out, the last two are as large as the tokens allow, as the query's contract knows no other bound than tokens.
    """
    pieces = staged(pieces_of(docs, path, length))
    groups = max(1, round(pieces.count() / pieces_a_group))
    how = {"length": length, "most_docs": most_docs or length, "most_cost": most_cost or float(length) ** 2, "weights": weights, "rule": rule}
    return pieces.repartition(groups).mapInArrow(_pack(**how), PACKED)


def op6_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
