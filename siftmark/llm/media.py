"""Operator 6: motion-JPEG AVI media columns.

``encode_media`` stores bytes as AVI clips whose frames are baseline JPEG images: each
byte is one 8x8 block of constant brightness, held by its DC coefficient alone, so
the entropy coding keeps it exactly.  ``read_avi`` parses the RIFF index, decodes the
intra frames and gives the bytes back; ``media_clips`` finds shots by histogram
differences against an adaptive threshold and yields timed clip rows.  Foreign
baseline motion-JPEG (AC coefficients, several components, restart intervals, frames
that leave the usual Huffman tables out) decodes by the general path.

Defined results: null text is an empty payload (64 zero bytes once padded); a null
doc_id is kept; equal texts give equal media; an empty table gives no rows.  Media that
are no AVI or hold a broken frame raise in ``read_avi``; in ``media_clips`` each such is a
row with the error and no clip, and null media give no row.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Blocks across a frame, and down at most.
BLOCKS_WIDE, BLOCKS_HIGH = 64, 64
FRAMES_PER_SECOND = 25
UNIT = 64
#: Output batches are cut at about this many bytes.
BATCH_BYTES = 4 << 20


def _symbols() -> np.ndarray:
    """10-bit symbol of each DC difference -255..255: prefix code, magnitude bits, end of block.

    The code of category k has 9 - k bits (8 - k ones and a zero), so each symbol has
    9 - k + k + 1 bits, whatever its category.
    """
    d = np.arange(-255, 256)
    k = np.array([int(abs(x)).bit_length() for x in d])
    code = (1 << (9 - k)) - 2
    bits = np.where(d < 0, d + (1 << k) - 1, d)
    return ((((code << k) | bits) << 1)).astype(np.uint16)


SYMBOLS = _symbols()
DIFFERENCES = np.full(1024, -999, np.int16)
DIFFERENCES[SYMBOLS] = np.arange(-255, 256)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _jpeg_head(rows: int) -> bytes:
    return b"".join((
        b"\xff\xd8",
        _segment(0xDB, bytes([0, 8] + [1] * 63)),
        _segment(0xC0, struct.pack(">BHHB", 8, 8 * rows, 8 * BLOCKS_WIDE, 1) + bytes([1, 0x11, 0])),
        _segment(0xC4, bytes([0x00] + [1] * 9 + [0] * 7) + bytes(range(8, -1, -1))),
        _segment(0xC4, bytes([0x10, 1] + [0] * 15) + b"\0"),
        _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
    ))


def _scan(values: np.ndarray) -> bytes:
    """Entropy-coded data of one frame's block values."""
    d = values.astype(np.int16)
    d[1:] -= values[:-1]
    d[0] -= 128
    s = SYMBOLS[d + 255].reshape(-1, 4)
    out = np.empty((len(s), 5), np.uint8)
    a, b, c, e = s[:, 0], s[:, 1], s[:, 2], s[:, 3]
    out[:, 0] = a >> 2
    out[:, 1] = (a & 3) << 6 | b >> 4
    out[:, 2] = (b & 15) << 4 | c >> 6
    out[:, 3] = (c & 63) << 2 | e >> 8
    out[:, 4] = e & 255
    return out.tobytes().replace(b"\xff", b"\xff\x00")


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def encode_avi(payload: bytes) -> bytes:
    """AVI file holding ``payload``, whose length is a positive multiple of 64."""
    n = len(payload)
    rows = -(-n // BLOCKS_WIDE)
    frames = -(-rows // BLOCKS_HIGH)
    high = -(-rows // frames)
    values = np.zeros(frames * high * BLOCKS_WIDE, np.uint8)
    values[:n] = np.frombuffer(payload, np.uint8)
    head, index, movi, at = _jpeg_head(high), [], [], 4
    for frame in values.reshape(frames, -1):
        chunk = _chunk(b"00dc", head + _scan(frame) + b"\xff\xd9")
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, struct.unpack_from("<I", chunk, 4)[0]))
        movi.append(chunk)
        at += len(chunk)
    largest = max(len(x) for x in movi)
    width, height = 8 * BLOCKS_WIDE, 8 * high
    avih = struct.pack("<14I", 1_000_000 // FRAMES_PER_SECOND, largest * FRAMES_PER_SECOND, 0, 0x10, frames, 0, 1, largest, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIiI4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FRAMES_PER_SECOND, 0, frames, largest, -1, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    body = b"AVI " + _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + strl)
    body += _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", b"payload=%d" % n))
    body += _chunk(b"LIST", b"movi" + b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


@dataclass
class Clip:
    """A parsed AVI file: JPEG frames in index order."""

    width: int
    height: int
    fps: float
    frames: list[bytes]
    comment: bytes


def parse_avi(media: bytes) -> Clip:
    """Walk the RIFF lists; frames come by idx1, or by walking movi where there is none."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    found: dict[bytes, tuple[int, int]] = {}
    walked: list[tuple[int, int]] = []

    def walk(at: int, end: int) -> None:
        while at + 8 <= end:
            name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
            if at + 8 + size > end:
                raise ValueError("a RIFF chunk reaches past its parent")
            if name == b"LIST":
                kind = media[at + 8 : at + 12]
                found.setdefault(kind, (at + 8, size))
                walk(at + 12, at + 8 + size)
            elif name[2:] in (b"dc", b"db"):
                walked.append((at + 8, size))
            else:
                found.setdefault(name, (at + 8, size))
            at += 8 + size + (size & 1)

    walk(12, 8 + struct.unpack_from("<I", media, 4)[0])
    avih = struct.unpack_from("<14I", media, found[b"avih"][0])
    scale, rate = struct.unpack_from("<II", media, found[b"strh"][0] + 20)
    if b"idx1" in found:
        at, size = found[b"idx1"]
        base, walked = found[b"movi"][0], []
        for name, _, offset, length in struct.iter_unpack("<4sIII", media[at : at + size]):
            if name[2:] in (b"dc", b"db"):
                start = base + offset if offset < found[b"movi"][1] else offset
                walked.append((start + 8, length))
    at, size = found.get(b"ICMT", (0, 0))
    return Clip(avih[8], avih[9], rate / max(1, scale), [media[a : a + n] for a, n in walked], media[at : at + size])


class _Bits:
    """Bits of entropy-coded data, most significant first."""

    def __init__(self, data: bytes):
        self.bits, self.at = np.unpackbits(np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8)).tolist(), 0

    def take(self, n: int) -> int:
        x = 0
        for b in self.bits[self.at : self.at + n]:
            x = x << 1 | b
        self.at += n
        return x

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.bits[self.at]
            self.at += 1
            if (n, code) in codes:
                return codes[n, code]
        raise ValueError("no such Huffman code")

    def value(self, n: int) -> int:
        x = self.take(n)
        return x if not n or x >> (n - 1) else x - (1 << n) + 1


def _codes(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    out, code, k = {}, 0, 0
    for n, count in enumerate(counts, 1):
        for _ in range(count):
            out[n, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def zigzag() -> list[int]:
    """Place of each coefficient in a block, by the rule of the diagonals."""
    cells = sorted(((y + x, (y if (y + x) % 2 else x), y, x) for y in range(8) for x in range(8)))
    return [8 * y + x for _, _, y, x in cells]


def _usual(counts: tuple[int, ...], first: tuple[int, ...]) -> tuple[bytes, bytes]:
    """A table of AC codes: the first symbols as listed, then all others, by run and size."""
    every = [0x00, 0xF0, *(16 * run + size for run in range(16) for size in range(1, 11))]
    return bytes(counts), bytes([*first, *sorted(set(every) - set(first))])


# The usual Huffman tables, which motion-JPEG frames may leave out (by class and number; codes by length, symbols).
USUAL_TABLES = {
    0x00: (bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes(range(12))),
    0x01: (bytes([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]), bytes(range(12))),
    0x10: _usual(
        (0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125),
        (0x01, 0x02, 0x03, 0x00, 0x04, 0x11, 0x05, 0x12, 0x21, 0x31, 0x41, 0x06, 0x13, 0x51, 0x61, 0x07, 0x22, 0x71, 0x14, 0x32, 0x81, 0x91, 0xA1, 0x08, 0x23, 0x42, 0xB1, 0xC1, 0x15, 0x52, 0xD1, 0xF0, 0x24, 0x33, 0x62, 0x72, 0x82),
    ),
    0x11: _usual(
        (0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119),
        (0x00, 0x01, 0x02, 0x03, 0x11, 0x04, 0x05, 0x21, 0x31, 0x06, 0x12, 0x41, 0x51, 0x07, 0x61, 0x71, 0x13, 0x22, 0x32, 0x81, 0x08, 0x14, 0x42, 0x91, 0xA1, 0xB1, 0xC1, 0x09, 0x23, 0x33, 0x52, 0xF0, 0x15, 0x62, 0x72, 0xD1, 0x0A, 0x16, 0x24, 0x34, 0xE1, 0x25, 0xF1),
    ),
}


def decode_frame(jpeg: bytes) -> tuple[np.ndarray, np.ndarray | None]:
    """Brightness of each 8x8 block of the first component, and its pixels where AC coefficients exist."""
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    at, quant, huff, restart = 2, {}, {}, 0
    while True:
        marker, size = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        body = jpeg[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[65 + 64 * wide :]
        elif marker in (0xC0, 0xC1):
            _, height, width, n = struct.unpack_from(">BHHB", body)
            parts = [tuple(body[6 + 3 * k : 9 + 3 * k]) for k in range(n)]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                huff[body[0]] = _codes(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            tables = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
            break
        elif marker in (0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
            raise ValueError("only baseline JPEG is decoded")
    for number, table in USUAL_TABLES.items():
        if number not in huff and any(number & 15 == (t & 15 if number >> 4 else t >> 4) for t in tables.values()):
            huff[number] = _codes(*table)
    data = jpeg[at : jpeg.rindex(b"\xff\xd9")]
    high, across = -(-height // 8), -(-width // 8)
    even = {s: n for (n, _), s in huff.get(0x00, {}).items()}
    if len(parts) == 1 and not restart and huff.get(0x10) == {(1, 0): 0} and all(n + s == 9 for s, n in even.items()) and across * high % 4 == 0 and quant[parts[0][2]][0] == 8 and set(tables.values()) == {0}:
        packed = np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8).reshape(-1, 5).astype(np.uint16)
        s = np.empty((len(packed), 4), np.uint16)
        s[:, 0] = packed[:, 0] << 2 | packed[:, 1] >> 6
        s[:, 1] = (packed[:, 1] & 63) << 4 | packed[:, 2] >> 4
        s[:, 2] = (packed[:, 2] & 15) << 6 | packed[:, 3] >> 2
        s[:, 3] = (packed[:, 3] & 3) << 8 | packed[:, 4]
        d = DIFFERENCES[s.ravel()]
        if d.size != across * high or d.size and d.min() < -255:
            raise ValueError("broken entropy-coded data")
        return (np.cumsum(d, dtype=np.int64) + 128).astype(np.uint8).reshape(high, across), None
    return _decode_general(data, height, width, parts, quant, huff, tables, restart)


def _decode_general(data, height, width, parts, quant, huff, tables, restart):
    most_h, most_v = max(p[1] >> 4 for p in parts), max(p[1] & 15 for p in parts)
    if len(parts) == 1:
        most_h = most_v = 1
        parts = [(parts[0][0], 0x11, parts[0][2])]
    wide, tall = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    h, v = parts[0][1] >> 4, parts[0][1] & 15
    blocks = np.zeros((tall * v, wide * h, 64), np.int64)
    order, sections, k = zigzag(), [], 0
    while (k := data.find(b"\xff", k)) >= 0:  # restart markers end sections
        if 0xD0 <= data[k + 1] <= 0xD7:
            sections.append(k)
        k += 2
    edges = [-2, *sections, len(data)]
    pieces = iter([data[a + 2 : b] for a, b in zip(edges, edges[1:], strict=False)])
    bits, before = None, {}
    for unit in range(wide * tall):
        if bits is None or restart and unit % restart == 0:
            bits, before = _Bits(next(pieces)), {p[0]: 0 for p in parts}
        for ident, sampling, _ in parts:
            dc, ac = huff[tables[ident] >> 4], huff[0x10 | tables[ident] & 15]
            for cell in range((sampling >> 4) * (sampling & 15)):
                block = np.zeros(64, np.int64)
                before[ident] += bits.value(bits.symbol(dc))
                block[0], at = before[ident], 1
                while at < 64:
                    x = bits.symbol(ac)
                    if x == 0:
                        break
                    at += x >> 4
                    if x != 0xF0:
                        block[at] = bits.value(x & 15)
                    at += 1
                if ident == parts[0][0]:
                    y, x = unit // wide * v + cell // h, unit % wide * h + cell % h
                    blocks[y, x, order] = block * quant[parts[0][2]]
    c = np.array([[np.cos((2 * i + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for i in range(8)] for u in range(8)])
    grid = blocks.reshape(*blocks.shape[:2], 8, 8)
    cells = np.einsum("ui,yxuv,vj->yxij", c, grid, c)
    pixels = np.clip(np.rint(cells.transpose(0, 2, 1, 3).reshape(8 * blocks.shape[0], -1) + 128), 0, 255)[:height, :width].astype(np.uint8)
    means = np.clip(np.rint(blocks[..., 0] / 8 + 128), 0, 255).astype(np.uint8)
    return means[: -(-height // 8), : -(-width // 8)], pixels


def read_avi(media: bytes) -> tuple[bytes, Clip, list[np.ndarray]]:
    """Payload (empty for foreign media), the parsed file and each frame's block brightness."""
    clip = parse_avi(media)
    frames = [decode_frame(f)[0] for f in clip.frames]
    payload = b""
    if clip.comment.startswith(b"payload="):
        payload = b"".join(f.tobytes() for f in frames)[: int(clip.comment[8:].rstrip(b"\0"))]
    return payload, clip, frames


def shots(frames: list[np.ndarray], window: int = 8, factor: float = 3.0, least: float = 0.3) -> list[tuple[int, int, float]]:
    """(first frame, end frame, mean brightness) of each shot.

    A cut lies where the histogram difference exceeds both ``least`` and the mean plus
    ``factor`` deviations of the differences since the last cut, ``window`` at most.
    """
    hists = [np.bincount(f.ravel() >> 2, minlength=64) / f.size for f in frames]
    cuts, recent = [0], []
    for k in range(1, len(frames)):
        d = float(np.abs(hists[k] - hists[k - 1]).sum()) / 2
        if d > max(least, float(np.mean(recent)) + factor * float(np.std(recent)) if recent else least):
            cuts.append(k)
            recent = []
        else:
            recent = [*recent, d][-window:]
    ends = [*cuts[1:], len(frames)]
    return [(a, b, sum(float(f.mean()) for f in frames[a:b]) / (b - a)) for a, b in zip(cuts, ends, strict=True) if b > a]


def _batches(rows: Iterator[tuple[dict, int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row, weight in rows:
        held.append(row)
        size += weight
        if size > BATCH_BYTES or len(held) >= 10_000:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _run(df: DataFrame, spark_schema: str, schema: pa.Schema, each) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for k, column in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    yield from each(k, column)

        yield from _batches(rows(), schema)

    return df.mapInArrow(run, spark_schema)


def encode_media(docs: DataFrame) -> DataFrame:
    """``doc_id, media``: each text's UTF-8 bytes, padded with zeros, as an AVI file; and ``n_bytes``."""

    def each(doc, text):
        data = b"" if not text.is_valid else text.as_buffer().to_pybytes()
        media = encode_avi(data + b"\0" * (-len(data) % UNIT or (0 if data else UNIT)))
        yield {"doc_id": doc, "n_bytes": len(data), "media": media}, len(media)

    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
    return _run(docs.select("doc_id", "text"), "doc_id long, n_bytes long, media binary", schema, each)


def media_clips(media: DataFrame) -> DataFrame:
    """A row for each shot of ``media(doc_id, media)``: clip number, start and end in seconds, frames, brightness; or the ``error`` of broken media."""

    def each(doc, cell):
        if not cell.is_valid:
            return
        try:
            _, clip, frames = read_avi(cell.as_buffer().to_pybytes())
            found = [{"doc_id": doc, "clip": k, "start_s": a / clip.fps, "end_s": b / clip.fps, "frames": b - a, "brightness": light} for k, (a, b, light) in enumerate(shots(frames))]
        except Exception as e:  # noqa: BLE001  broken media break in many ways; each is its own row's error
            found = [{"doc_id": doc, "error": f"{type(e).__name__}: {e}"}]
        for row in found:
            yield row, 60

    schema = pa.schema([("doc_id", pa.int64()), ("clip", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("frames", pa.int32()), ("brightness", pa.float64()), ("error", pa.string())])
    return _run(media.select("doc_id", "media"), "doc_id long, clip int, start_s double, end_s double, frames int, brightness double, error string", schema, each)


def media_digest(media: DataFrame) -> DataFrame:
    """What the stored bytes give back: payload digests, the media's own, and the clips as one string."""

    def each(doc, cell):
        stored = cell.as_buffer().to_pybytes()
        payload, clip, frames = read_avi(stored)
        feature = f"{clip.width}x{clip.height}@{clip.fps:g};" + "|".join(f"{a / clip.fps:.2f}-{b / clip.fps:.2f}:{light:.3f}" for a, b, light in shots(frames))
        yield {
            "doc_id": doc["doc_id"], "n_bytes": doc["n_bytes"], "payload_bytes": len(payload),
            "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-UNIT:]),
            "media_bytes": len(stored), "media_sha256": hashlib.sha256(stored).hexdigest(), "feature": feature,
        }, 400

    kinds = {"doc_id": "long", "n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string"}
    schema = pa.schema([(k, pa.int64() if t == "long" else pa.string()) for k, t in kinds.items()])
    rows = media.select(F.struct("doc_id", "n_bytes").alias("key"), "media")
    return _run(rows, ", ".join(f"{k} {t}" for k, t in kinds.items()), schema, each)


def media_round_trip(docs: DataFrame) -> DataFrame:
    return media_digest(encode_media(docs))
