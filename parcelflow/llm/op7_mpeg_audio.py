"""Media columns: payloads kept in MPEG-1 Layer III streams, written, scanned and read back.

A payload travels as ancillary data: every frame's side information announces no coded audio, so the bytes behind it
are free and players hear silence. A stream is an ID3v2.3 tag (with the payload's length), an Info/Xing frame with frame
count, byte count and a table of 100 seek points, frames of 320 kbit/s and a last frame of the smallest bit rate that
holds the rest, and an ID3v1 tag. All frames carry the CRC-16 of their header and side information.

The scanner knows nothing of the writer: it skips tags, finds a header whose successor is a header too, checks the CRC of
every frame of layers I, II and III that has one, loses and finds its place again after damage, reads Xing or VBRI tables, and reports exact duration and the offset
of every frame.

Defined results: a null text counts as empty; an empty text is 64 zero bytes; equal texts give equal streams; a null
doc_id stays null; other columns play no part. Streams are bounded by the text's size plus about 2 %.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

# Fixed values of the format: bit rates (kbit/s) by index for version 1 and versions 2/2.5, sample rates (Hz) by version.
RATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HERTZ = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}
VERSIONS = {0: 2.5, 2: 2, 3: 1}
# Fixed values of layer II: bits of a subband's allocation, as runs of (subbands, bits), by table.
ALLOCATION = {"a": ((11, 4), (12, 3), (4, 2)), "b": ((11, 4), (12, 3), (7, 2)), "c": ((2, 4), (6, 3)), "d": ((2, 4), (10, 3)), "low": ((4, 4), (7, 3), (19, 2))}
HEADER = 0xFFFA08C0  # version 1, layer III, with CRC, 32 kHz, one channel; the rate's index is missing
SIDE = 17
SAMPLES, HZ = 1152, 32000

MEDIA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, seconds double, frame_offsets array<long>"


def crc16(data: bytes, crc: int = 0xFFFF) -> int:
    """The format's CRC: polynomial 0x8005, most significant bit first, from all ones."""
    for x in data:
        crc ^= x << 8
        for _ in range(8):
            crc = ((crc << 1) ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


crc_of = lru_cache(4096)(crc16)


def crc16_bits(data: bytes, bits: int, crc: int) -> int:
    """The CRC carried on over so many bits."""
    for k in range(bits):
        crc ^= (data[k >> 3] >> (7 - (k & 7)) & 1) << 15
        crc = ((crc << 1) ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def _bits(data: bytes, at: int, n: int) -> int:
    return int.from_bytes(data[at >> 3 : (at + n + 7) >> 3]) >> (-(at + n) & 7) & ((1 << n) - 1)


def protected_bits(four: bytes, body: bytes) -> int:
    """How many bits behind a layer I or II frame's CRC it covers: the allocation, and in layer II the scale factor selection."""
    (x,) = struct.unpack(">I", four)
    version, layer, _, hz, *_ = header(four)
    mode, channels = x >> 6 & 3, 1 if x >> 6 & 3 == 3 else 2
    bound = 4 * ((x >> 4 & 3) + 1) if mode == 1 else 32
    if layer == 1:
        return 128 if channels == 1 else 4 * (bound + 32)
    kbit = RATES[1 if version == 1 else 2, 2][x >> 12 & 15] // channels
    if version != 1:
        table = "low"
    elif kbit in (32, 48):
        table = "d" if hz == 32000 else "c"
    else:
        table = "a" if hz == 48000 or kbit in (56, 64, 80) else "b"
    at, used, band = 0, 0, 0
    for bands, width in ALLOCATION[table]:
        for _ in range(bands):
            each = channels if band < bound else 1
            for _ in range(each):
                used += (_bits(body, at, width) > 0) * (channels if each < channels else 1)
                at += width
            band += 1
    return at + 2 * used


@lru_cache(4096)
def header(four: bytes) -> tuple | None:
    """(version, layer, has a CRC, sample rate, samples, frame bytes, side information bytes), or None."""
    (x,) = struct.unpack(">I", four)
    version, layer, rate, hertz = VERSIONS.get(x >> 19 & 3), 4 - (x >> 17 & 3), x >> 12 & 15, x >> 10 & 3
    if x >> 21 != 0x7FF or version is None or layer == 4 or rate in (0, 15) or hertz == 3:
        return None
    hz, kbit, pad = HERTZ[version][hertz], RATES[1 if version == 1 else 2, layer][rate], x >> 9 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 1 else 576
    size = (12000 * kbit // hz + pad) * 4 if layer == 1 else samples * 125 * kbit // hz + pad
    mono = x >> 6 & 3 == 3
    side = 0 if layer != 3 else (17 if mono else 32) if version == 1 else (9 if mono else 17)
    return version, layer, not x >> 16 & 1, hz, samples, size, side


@lru_cache(16)
def _frame(kbit: int) -> tuple[bytes, int]:
    """A frame's bytes before the ancillary data, and how many of those fit."""
    four = struct.pack(">I", HEADER | RATES[1, 3].index(kbit) << 12)
    return four + struct.pack(">H", crc16(four[2:] + bytes(SIDE))) + bytes(SIDE), header(four)[5] - 6 - SIDE


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def write_stream(payload: bytes) -> bytes:
    head, room = _frame(320)
    whole = max(0, -(-len(payload) // room) - 1)
    out = [head + payload[k * room : (k + 1) * room] for k in range(whole)]
    rest = payload[whole * room :]
    tail, size = next((x for x in map(_frame, RATES[1, 3][1:]) if x[1] >= len(rest)))
    out.append(tail + rest + bytes(size - len(rest)))
    length = b"PAYLOAD\0" + str(len(payload)).encode()
    body = b"TXXX" + struct.pack(">I", len(length) + 1) + b"\0\0\0" + length
    first, _ = _frame(128)
    total, ends, at = header(first[:4])[5] + sum(map(len, out)), [], header(first[:4])[5]
    for k in range(100):
        ends.append(min(255, 256 * (at + (k * len(out) // 100) * len(out[0])) // total))
    kind = b"Xing" if whole and len(tail) + size != len(out[0]) else b"Info"
    info = kind + struct.pack(">III", 7, len(out), total) + bytes(ends)
    start = b"ID3\3\0\0" + _syncsafe(len(body)) + body
    return b"".join([start, first, info, bytes(header(first[:4])[5] - len(first) - len(info)), *out, b"TAG" + b"payload".ljust(125, b"\0")])


def scan(data: bytes) -> dict:
    """Tags, table, frames [(offset, bytes, ancillary start)], CRC failures, bytes skipped, and the exact duration in seconds."""
    at, end, tags, text = 0, len(data), [], {}
    while data[at : at + 3] == b"ID3" and at + 10 <= end:
        size = sum((data[at + 6 + k] & 127) << 7 * (3 - k) for k in range(4))
        place, stop, safe = at + 10, min(end, at + 10 + size), data[at + 3] >= 4
        tags.append(f"ID3v2.{data[at + 3]}")
        while place + 10 <= stop and data[place] and data[at + 3] >= 3:
            n = sum((data[place + 4 + k] & 127) << 7 * (3 - k) for k in range(4)) if safe else struct.unpack(">I", data[place + 4 : place + 8])[0]
            if data[place : place + 4] == b"TXXX" and n:
                name, _, value = data[place + 11 : min(stop, place + 10 + n)].partition(b"\0")
                text[name.decode("latin-1")] = value.decode("latin-1")
            place += 10 + n
        at += 10 + size + 10 * (data[at + 5] >> 4 & 1)
    if data[max(at, end - 128) :][:3] == b"TAG" and end - 128 >= at:
        end -= 128
        tags.append("ID3v1")
    frames, bad, skipped, table, lost, duration, kinds = [], 0, 0, None, True, Fraction(0), set()
    while at + 4 <= end:
        h = header(data[at : at + 4])
        follows = h and at + h[5] <= end and (at + h[5] + 4 > end or header(data[at + h[5] : at + h[5] + 4]) is not None)
        if not h or at + h[5] > end or (lost and not follows):
            nxt = data.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            skipped, at, lost = skipped + nxt - at, nxt, True
            continue
        lost, (version, layer, has_crc, hz, samples, size, side) = False, h
        body = at + 4 + 2 * has_crc + side
        if has_crc and layer == 3:
            bad += crc_of(data[at + 2 : at + 4] + data[at + 6 : body]) != int.from_bytes(data[at + 4 : at + 6])
        elif has_crc:
            four, rest = data[at : at + 4], data[at + 6 : at + size]
            bad += crc16_bits(rest, min(8 * len(rest), protected_bits(four, rest)), crc_of(four[2:])) != int.from_bytes(data[at + 4 : at + 6])
        if not frames and table is None and (found := _table(data, at, body, size)):
            table = found
        else:
            frames.append((at, size, body))
            duration += Fraction(samples, hz)
            kinds.add((version, layer, hz))
        at += size
    return {"tags": tags, "text": text, "table": table, "frames": frames, "bad_crc": bad, "skipped": skipped + max(0, end - at), "duration": duration, "kinds": kinds}


def _table(data: bytes, at: int, body: int, size: int) -> dict | None:
    if data[body : body + 4] in (b"Xing", b"Info"):
        (flags,), place, out = struct.unpack(">I", data[body + 4 : body + 8]), body + 8, {"kind": data[body : body + 4].decode()}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name], place = int.from_bytes(data[place : place + 4]), place + 4
        if flags & 4:
            out["seek"] = list(data[place : place + 100])
        return out
    place = at + 4 + 32
    if data[place : place + 4] == b"VBRI" and place + 26 <= at + size:
        total, count, n, scale, width, each = struct.unpack(">IIHHHH", data[place + 10 : place + 26])
        seek = [int.from_bytes(data[place + 26 + k * width : place + 26 + (k + 1) * width]) * scale for k in range(n)]
        return {"kind": "VBRI", "bytes": total, "frames": count, "seek": seek, "frames_per_entry": each}
    return None


def read_payload(data: bytes, found: dict | None = None) -> bytes:
    found = found or scan(data)
    return b"".join([data[body : at + size] for at, size, body in found["frames"]])[: int(found["text"]["PAYLOAD"])]


def feature(found: dict) -> str:
    """What the scan found, as one line: format, exact duration, table, checks and a digest of all frame offsets."""
    version, layer, hz = next(iter(found["kinds"]), (0, 0, 1))
    offsets = zlib.crc32(struct.pack(f"<{len(found['frames'])}Q", *[x[0] for x in found["frames"]]))
    table = found["table"] or {}
    agrees = table.get("frames") == len(found["frames"])
    return f"mpeg{version}-layer{layer};hz={hz};frames={len(found['frames'])};seconds={found['duration']};table={table.get('kind', 'none')}:{'agrees' if agrees else 'differs'};bad_crc={found['bad_crc']};skipped={found['skipped']};tags={'+'.join(found['tags'])};offsets_crc32={offsets}"


def store(payload: bytes) -> tuple[bytes, dict]:
    media = write_stream(payload)
    return media, scan(media)


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts, out = batch.column(0), batch.column(1), []
        for text in texts:
            raw = (text.as_py() or "").encode()
            media, found = store(raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0"))
            back = read_payload(media, found)
            out.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(found), float(found["duration"]), [x[0] for x in found["frames"]]))
        columns = list(zip(*out, strict=True)) or [()] * 9
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "seconds", "frame_offsets"])


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):  # one stream at a time: memory is bounded by the longest payload
            found_media, found = store(batch.column(1)[k].as_py() or b"")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(k, 1), pa.array([found_media], pa.binary()), pa.array([float(found["duration"])], pa.float64()), pa.array([[x[0] for x in found["frames"]]], pa.list_(pa.int64()))],
                names=["doc_id", "media", "seconds", "frame_offsets"],
            )


def to_media(payloads: DataFrame) -> DataFrame:
    """(doc_id, payload) to (doc_id, media, seconds, frame_offsets): a column of streams to write as a table."""
    return payloads.select(F.col("doc_id").cast("long").alias("doc_id"), "payload").mapInArrow(_write, "doc_id long, media binary, seconds double, frame_offsets array<long>")


def media_columns(docs: DataFrame) -> DataFrame:
    """Store every text's payload, read it back and describe both. No shuffle; a row depends on its text alone."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_columns, MEDIA)


def op7_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(documents(spark, sf_dir))
