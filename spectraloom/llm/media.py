"""Media columns: AVI with motion-JPEG frames, its index, its frames and its shots.

A payload byte is stored as one grey 8x8 block of a baseline JPEG: with the quantiser
8 the block's DC value is the byte less 128, so every decoder gives back exactly that
grey in all 64 pixels. The DC codes are chosen so that code and extra bits make up nine
bits for every difference, one more bit ends the block: a frame's scan is an array of ten-bit
fields that numpy packs and unpacks without a loop.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.llm.common import bounded_batches

#: Blocks in a row, block rows in a frame at most, frames in a second.
WIDTH, HEIGHT, FPS = 64, 32, 25
BINS = 16


@lru_cache(None)
def _diff_fields() -> np.ndarray:
    """The ten-bit field of each DC difference from -255 to 255.

    Category c (0 to 8) has a code of 9 - c bits, 8 - c ones and a zero, as the canonical order
    of these lengths gives it; c extra bits follow, then the end-of-block code, a zero.
    """
    out = np.zeros(511, np.uint16)
    for d in range(-255, 256):
        c = abs(d).bit_length()
        code = ((1 << (8 - c)) - 1) << 1
        extra = d if d > 0 else d + (1 << c) - 1
        out[d + 255] = ((code << c) | (extra if c else 0)) << 1
    return out


@lru_cache(None)
def _field_diffs() -> np.ndarray:
    back = np.full(1 << 10, 9999, np.int16)
    back[_diff_fields()] = np.arange(-255, 256)
    return back


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_DQT = _segment(0xDB, bytes([0]) + bytes([8] + [1] * 63))
_DHT = _segment(0xC4, bytes([0x00]) + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1))) + _segment(0xC4, bytes([0x10]) + bytes([1] + [0] * 15) + bytes([0]))
_SOS = _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))


def encode_frame(samples: np.ndarray) -> bytes:
    """JPEG of a (rows, columns) array of bytes, one block a byte."""
    rows, columns = samples.shape
    flat = samples.astype(np.int16).ravel() - 128
    fields = _diff_fields()[np.diff(flat, prepend=np.int16(0)) + 255]
    bits = np.unpackbits(fields.astype(">u2").view(np.uint8)).reshape(-1, 16)[:, 6:].ravel()
    scan = np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])).tobytes().replace(b"\xff", b"\xff\x00")
    size = _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, columns * 8, 1) + bytes([1, 0x11, 0]))
    return b"\xff\xd8" + _DQT + size + _DHT + _SOS + scan + b"\xff\xd9"


class MediaError(ValueError):
    """A stream that is not what these readers know."""


def decode_frame(data: bytes) -> np.ndarray:
    """The (rows, columns) DC image of a baseline grey JPEG.

    Tables and sizes come from the file. Scans whose DC codes and extra bits have one
    common length, with an end of block alone beside them, are unpacked at once; others are
    read bit by bit, their AC coefficients skipped over. Values are those of the block's mean.
    """
    if data[:2] != b"\xff\xd8":
        raise MediaError("no JPEG")
    at, tables, quant, shape = 2, {}, {}, None
    while True:
        marker, length = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == 0xDB:
            while body:
                wide = 1 + (body[0] >> 4)
                quant[body[0] & 15] = int.from_bytes(body[1 : 1 + wide], "big")
                body = body[1 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                counts = body[1:17]
                tables[body[0]] = (bytes(counts), body[17 : 17 + sum(counts)])
                body = body[17 + sum(counts) :]
        elif marker == 0xC0:
            _, rows, columns, parts = struct.unpack(">BHHB", body[:6])
            if parts != 1:
                raise MediaError("only grey frames are decoded")
            shape, q = (-(-rows // 8), -(-columns // 8)), body[8]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise MediaError("only baseline frames are decoded")
        elif marker == 0xDA:
            dc, ac = body[2] >> 4, 0x10 | body[2] & 15
            break
    end = data.rfind(b"\xff\xd9")
    scan = data[at:end].replace(b"\xff\x00", b"\xff")
    n = shape[0] * shape[1]
    if tables[dc] == (bytes([1] * 9 + [0] * 7), bytes(range(8, -1, -1))) and tables[ac] == (bytes([1] + [0] * 15), b"\0"):
        bits = np.unpackbits(np.frombuffer(scan, np.uint8))[: 10 * n].reshape(n, 10)
        fields = bits[:, :2] @ np.array([512, 256], np.uint16) + np.packbits(bits[:, 2:], axis=1)[:, 0]
        steps = _field_diffs()[fields]
        if steps.max(initial=0) > 255:
            raise MediaError("a field that no difference has")
        levels = np.cumsum(steps, dtype=np.int64)
    else:
        levels = np.array(_slow_levels(scan, n, tables[dc], tables[ac]), np.int64)
    return np.clip((levels * quant[q] + 4) // 8 + 128, 0, 255).astype(np.uint8).reshape(shape)


def _slow_levels(scan: bytes, n: int, dc: tuple[bytes, bytes], ac: tuple[bytes, bytes]) -> list[int]:
    def codes(table):
        out, code, k = {}, 0, 0
        for length, count in enumerate(table[0], 1):
            for _ in range(count):
                out[length, code] = table[1][k]
                code, k = code + 1, k + 1
            code <<= 1
        return out

    bits, at = np.unpackbits(np.frombuffer(scan, np.uint8)).tolist(), 0

    def take(count: int) -> int:
        nonlocal at
        value = int("".join(map(str, bits[at : at + count])) or "0", 2)
        at += count
        return value

    def symbol(known) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | take(1)
            if (length, code) in known:
                return known[length, code]
        raise MediaError("a code that no table has")

    first, rest, level, out = codes(dc), codes(ac), 0, []
    for _ in range(n):
        size = symbol(first)
        extra = take(size)
        level += extra if size and extra >> (size - 1) else extra - (1 << size) + 1
        k = 1
        while k < 64 and (pair := symbol(rest)) != 0:
            k += (pair >> 4) + 1
            take(pair & 15)
        out.append(level)
    return out


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def encode_avi(payload: bytes, width: int = WIDTH, height: int = HEIGHT, fps: int = FPS) -> bytes:
    """AVI (MJPG) that holds a payload of a positive multiple of `width` bytes, a byte a block.

    The last frame is filled up with zero rows; the INFO list keeps the payload's length.
    """
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    height = min(height, len(rows))
    frames = [rows[i : i + height] for i in range(0, len(rows), height)]
    if len(frames[-1]) < height:
        frames[-1] = np.vstack([frames[-1], np.zeros((height - len(frames[-1]), width), np.uint8)])
    coded = [encode_frame(f) for f in frames]
    movi, index = [b"movi"], []
    at = 4
    for f in coded:
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(f)))
        chunk = _chunk(b"00dc", f)
        movi.append(chunk)
        at += len(chunk)
    w, h, most = width * 8, height * 8, max(map(len, coded))
    avih = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, len(coded), 0, 1, most, w, h, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, fps, 0, len(coded), most, 0xFFFFFFFF, 0, 0, 0, w, h)
    strf = struct.pack("<IiiHH4sIiiII", 40, w, h, 1, 24, b"MJPG", w * h * 3, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + strl)
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", f"payload={len(payload)}".encode()))
    return _chunk(b"RIFF", b"AVI " + hdrl + info + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        yield data[at : at + 4], at + 8, at + 8 + size
        at += 8 + size + size % 2


def parse_avi(data: bytes) -> dict:
    """Frame rate, comment and frame positions, from the RIFF lists and the idx1 index.

    Without an index the movi list is walked instead.
    """
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise MediaError("no AVI")
    out: dict = {"fps": float(FPS), "comment": "", "frames": []}
    walked, movi, index = [], 0, None
    todo = [(12, min(len(data), 8 + int.from_bytes(data[4:8], "little")))]
    while todo:
        for name, a, b in _chunks(data, *todo.pop()):
            if name == b"LIST":
                movi = a if data[a : a + 4] == b"movi" else movi
                todo.append((a + 4, b))
            elif name == b"avih":
                out["fps"] = 1e6 / max(1, int.from_bytes(data[a : a + 4], "little"))
            elif name == b"ICMT":
                out["comment"] = data[a:b].decode("utf-8", "replace")
            elif name == b"idx1":
                index = data[a:b]
            elif name[2:] in (b"dc", b"db"):
                walked.append((a, b))
    if index is None:
        out["frames"] = sorted(walked)
    else:
        for i in range(0, len(index), 16):
            offset, size = struct.unpack("<II", index[i + 8 : i + 16])
            if index[i + 2 : i + 4] in (b"dc", b"db"):
                out["frames"].append((movi + offset + 8, movi + offset + 8 + size))
    return out


def decode_avi(data: bytes) -> tuple[dict, list[np.ndarray]]:
    found = parse_avi(data)
    return found, [decode_frame(data[a:b]) for a, b in found["frames"]]


def shots(frames: list[np.ndarray], window: int = 8, factor: float = 2.0, least: float = 0.05) -> list[tuple[int, int]]:
    """Frame ranges [first, last] between cuts.

    A cut stands where half the L1 distance of two frames' 16-bin histograms exceeds both
    `least` and the mean plus `factor` deviations of the `window` distances before it.
    """
    hist = np.array([np.bincount(f.ravel() >> 4, minlength=BINS) / f.size for f in frames])
    gaps = np.abs(np.diff(hist, axis=0)).sum(axis=1) / 2
    cuts = []
    for i, g in enumerate(gaps):
        past = gaps[max(0, i - window) : i]
        limit = past.mean() + factor * past.std() if len(past) else least
        if g > max(limit, least):
            cuts.append(i + 1)
    return list(zip([0, *cuts], [c - 1 for c in [*cuts, len(frames)]], strict=True))


def clip_rows(data: bytes) -> list[dict]:
    """Timed clips of an AVI: first and last frame, start and end in seconds, mean grey."""
    found, frames = decode_avi(data)
    if not frames:
        return []
    return [{"first": a, "last": b, "start_s": a / found["fps"], "end_s": (b + 1) / found["fps"], "mean": float(np.mean([f.mean() for f in frames[a : b + 1]]))} for a, b in shots(frames)]


def pad(payload: bytes, multiple: int = 64) -> bytes:
    return payload + bytes(-len(payload) % multiple or (0 if payload else multiple))


def read_payload(found: dict, frames: list[np.ndarray]) -> bytes:
    length = int(found["comment"].rpartition("=")[2])
    return b"".join(f.tobytes() for f in frames)[:length]


def feature_string(found: dict, frames: list[np.ndarray]) -> str:
    """Frames, clips and the histogram of all decoded samples, as a line of text."""
    total = sum(np.bincount(f.ravel() >> 4, minlength=BINS) for f in frames)
    clips = shots(frames)
    return f"frames={len(frames)};fps={found['fps']:g};clips={','.join(f'{a}-{b}' for a, b in clips)};hist={','.join(map(str, total.tolist()))}"


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def describe(text: str | None) -> tuple:
    raw = (text or "").encode()
    media = encode_avi(pad(raw))
    found, frames = decode_avi(media)
    back = read_payload(found, frames)
    return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature_string(found, frames)


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media binary) of every row; null texts are empty payloads."""
    bounded_batches(docs.sparkSession)

    def make(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.iloc[i : i + 256]
                yield pd.DataFrame({id_col: part[id_col], "media": [encode_avi(pad((t or "").encode())) for t in part[text_col]]})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInPandas(make, f"`{id_col}` {kind}, media binary")


def clips(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row for each clip of each AVI: id, clip, first, last, start_s, end_s, mean. Nulls have none."""
    bounded_batches(media.sparkSession)

    def cut(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{id_col: d, "clip": i, **c} for d, m in zip(batch[id_col], batch[media_col], strict=True) if m is not None for i, c in enumerate(clip_rows(m))]
            if rows:
                yield pd.DataFrame(rows)

    kind = media.schema[id_col].dataType.simpleString()
    return media.select(id_col, media_col).mapInPandas(cut, f"`{id_col}` {kind}, clip long, first long, last long, start_s double, end_s double, mean double")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The query's columns: each text stored, read back and described. One pass, no exchange.

    A null or empty text is an empty payload, padded to 64 bytes. Every row has a result: repeated rows repeat it,
    a null id stays null. Columns other than the two are not read. An empty table gives an empty one.
    """
    bounded_batches(docs.sparkSession)
    names = [x.split()[0] for x in DIGEST.split(", ")]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, *describe(t)) for d, t in zip(batch["doc_id"], batch["text"], strict=True)]
            yield pd.DataFrame(rows, columns=names)

    # Ids travel as text so that null ids do not turn the others into floats.
    plain = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    return plain.mapInPandas(run, DIGEST.replace("doc_id long", "doc_id string")).withColumn("doc_id", F.col("doc_id").cast("long"))
