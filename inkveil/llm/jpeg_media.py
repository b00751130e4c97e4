"""Baseline JPEG in and out: lossless payload images, and DC-only luminance thumbnails.

Writing. A payload byte is the value of one flat 8x8 block: its quantised DC coefficient is the byte less 128, its AC
coefficients are nought, and the DC quantiser of 8 makes that exact. Rows have 64 blocks, a restart interval each;
what exceeds the height a JPEG can have continues in further images in the same bytes.

Reading. Markers are parsed per image. Scans are unstuffed and cut at restart markers for a whole chunk of images at
once; every restart interval is a lane, and all lanes decode in step in numpy: 16 bits of each lane look up a whole
flat block (DC code, magnitude, end of block), and lanes with AC coefficients go on symbol by symbol. Interleaved
colour scans with any sampling are read the same way; the thumbnail takes the luminance blocks' DC values, an eighth of
the size each way.

Defined results. Null or empty text: 64 bytes of 0. Media that is null or no baseline JPEG: no images, empty thumbnail,
null feature. Repeated rows and ties have equal values; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._arrow import chunks, utf8

ROW, MOST_ROWS, CHUNK = 64, 8191, 1 << 20
#: Code lengths of the written tables: sizes 0 to 8 of a DC difference, and the end of a block alone.
_DC_LENGTHS = {0: 3, 1: 4, 2: 4, 3: 3, 4: 3, 5: 3, 6: 3, 7: 4, 8: 5}
_AC_LENGTHS = {0: 1}


def _codes(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Canonical Huffman codes: symbol -> (code, length)."""
    out, code, last = {}, 0, 0
    for symbol, n in sorted(lengths.items(), key=lambda x: (x[1], x[0])):
        code <<= n - last
        out[symbol], code, last = (code, n), code + 1, n
    return out


def _table(kind: int, lengths: dict[int, int]) -> bytes:
    counts = bytes(sum(n == i for n in lengths.values()) for i in range(1, 17))
    body = bytes([kind]) + counts + bytes(s for s, _ in sorted(lengths.items(), key=lambda x: (x[1], x[0])))
    return b"\xff\xc4" + struct.pack(">H", len(body) + 2) + body


_TABLES = _table(0x00, _DC_LENGTHS) + _table(0x10, _AC_LENGTHS)
_QUANTA = b"\xff\xdb" + struct.pack(">HB", 67, 0) + bytes([8] + [1] * 63)


def _head(rows: int) -> bytes:
    frame = b"\xff\xc0" + struct.pack(">HBHHB3B", 11, 8, rows * 8, ROW * 8, 1, 1, 0x11, 0)
    return b"\xff\xd8" + _QUANTA + frame + _TABLES + b"\xff\xdd" + struct.pack(">HH", 4, ROW) + b"\xff\xda" + struct.pack(">HB2B3B", 8, 1, 1, 0, 0, 63, 0)


@lru_cache(None)
def _block_bits() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number of a flat block by its DC difference + 255."""
    dc, (end, end_n) = _codes(_DC_LENGTHS), _codes(_AC_LENGTHS)[0]
    bits, n = [], []
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, length = dc[size]
        bits.append(((code << size | (d if d >= 0 else d + (1 << size) - 1)) << end_n) | end)
        n.append(length + size + end_n)
    return np.array(bits, np.int64), np.array(n, np.int64)


def write_images(payload: np.ndarray, rows: np.ndarray) -> list[bytes]:
    """One media value for each `rows[i]` rows of 64 bytes of the payload."""
    q = payload.reshape(-1, ROW).astype(np.int64) - 128
    diff = np.diff(q, axis=1, prepend=0) + 255
    table, sizes = _block_bits()
    value, n = table[diff], sizes[diff]
    stop = np.cumsum(n, axis=1)
    length = (stop[:, -1] + 7) // 8
    first = np.cumsum(length) - length
    at = (stop - n) + 8 * first[:, None]
    shifted = value << (24 - (at & 7) - n)
    byte = (at >> 3).ravel()
    out = np.zeros(int(length.sum()) + 2, np.int64)
    for k in range(3):
        out += np.bincount(byte + k, weights=((shifted >> (16 - 8 * k)) & 255).ravel(), minlength=len(out) + 3)[: len(out)].astype(np.int64)
    out = out[:-2]
    out[first + length - 1] += (1 << (-stop[:, -1] & 7)) - 1
    # Image of each row, its number in the image; a marker after each but the last.
    per = [min(MOST_ROWS, r - k) for r in rows.tolist() for k in range(0, r, MOST_ROWS)]
    images = np.array(per, np.int64)
    inner = np.arange(images.sum()) - np.repeat(np.cumsum(images) - images, images)
    marked = inner < np.repeat(images, images) - 1
    extra = (out == 255).astype(np.int64)
    extra[(first + length - 1)[marked]] += 2
    place = np.arange(len(out)) + np.cumsum(extra) - extra
    scan = np.zeros(len(out) + int(extra.sum()), np.uint8)
    scan[place] = out
    ends = (place + extra + 1)[first + length - 1]
    scan[ends[marked] - 2] = 0xFF
    scan[ends[marked] - 1] = 0xD0 + (inner[marked] & 7)
    cut = np.concatenate([[0], ends[np.cumsum(images) - 1]]).tolist()
    raw = scan.tobytes()
    whole = iter([_head(h) + raw[a:b] + b"\xff\xd9" for h, a, b in zip(per, cut[:-1], cut[1:], strict=True)])
    return [b"".join(next(whole) for _ in range(0, r, MOST_ROWS)) for r in rows.tolist()]


# ---- reading ------------------------------------------------------------------------------------------------------


class Image(NamedTuple):
    width: int
    height: int
    components: tuple[tuple[int, int, int, int, int], ...]  # id, h, v, DC table, AC table, in scan order
    quantum: int  # of the first component's DC
    huffman: tuple[tuple[int, bytes], ...]  # class and number, table
    interval: int  # in MCUs; 0: none
    scan: bytes


def parse(media: bytes | None) -> list[Image]:
    """The baseline images in these bytes, one after another; [] if there is anything else."""
    out, at = [], 0
    media = media or b""
    while media[at : at + 2] == b"\xff\xd8":
        at += 2
        quanta, huffman, size, parts, interval = {}, {}, None, (), 0
        while True:
            if media[at : at + 1] != b"\xff" or at + 4 > len(media):
                return []
            marker = media[at + 1]
            (n,) = struct.unpack_from(">H", media, at + 2)
            body, at = media[at + 4 : at + 2 + n], at + 2 + n
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    quanta[body[0] & 15] = struct.unpack_from(">H" if wide else ">B", body, 1)[0]
                    body = body[65 + 64 * wide :]
            elif marker == 0xC4:
                while body:
                    m = 17 + sum(body[1:17])
                    huffman[body[0]], body = body[1:m], body[m:]
            elif marker == 0xC0:
                size = struct.unpack_from(">HH", body, 1)
                parts = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])}
            elif marker == 0xDD:
                (interval,) = struct.unpack(">H", body)
            elif marker == 0xDA:
                if size is None or not size[0] or body[0] != len(parts):
                    return []
                scanned = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
                alone = len(scanned) == 1
                got = tuple((c, 1 if alone else parts[c][0], 1 if alone else parts[c][1], t >> 4, t & 15) for c, t in scanned)
                stop = media.find(b"\xff\xd9", at)
                if stop < 0:
                    return []
                out.append(Image(size[1], size[0], got, quanta[parts[scanned[0][0]][2]], tuple(sorted(huffman.items())), interval, media[at:stop]))
                at = stop + 2
                break
            elif 0xC1 <= marker <= 0xCF:
                return []
    return out if at == len(media) else []


@lru_cache(64)
def _symbols(table: bytes) -> np.ndarray:
    """For each 16 bits that may come next: symbol << 8 | code length; length 0: no code."""
    out, code, k = np.zeros(1 << 16, np.int32), 0, 16
    for n in range(1, 17):
        for _ in range(table[n - 1]):
            out[code << (16 - n) : (code + 1) << (16 - n)] = table[k] << 8 | n
            code, k = code + 1, k + 1
        code <<= 1
    return out


@lru_cache(64)
def _flat_blocks(dc: bytes, ac: bytes) -> np.ndarray:
    """For each 16 bits: (difference + 32768) << 8 | bits of a whole flat block; 0: it isn't one, or is longer."""
    peek = np.arange(1 << 16)
    size, n = _symbols(dc) >> 8, _symbols(dc) & 255
    used = n + size
    ok = (n > 0) & (used < 16)
    raw = np.where(ok, (peek >> np.maximum(16 - used, 0)) & ((1 << size) - 1), 0)
    diff = np.where((size > 0) & (raw < (1 << np.maximum(size - 1, 0))), raw - (1 << size) + 1, raw)
    after = _symbols(ac)[(peek << np.minimum(used, 16)) & 0xFFFF]
    end = after & 255
    ok &= (after >> 8 == 0) & (end > 0) & (used + end <= 16)
    return np.where(ok, (diff + 32768) << 8 | (used + end), 0).astype(np.int64)


def _rest(word: np.ndarray, at: np.ndarray, dc: np.ndarray, ac: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """DC differences and the bit after the block, for lanes whose blocks aren't flat. dc, ac: a table row for each lane."""

    def bits(p: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (word[p >> 3] << (p & 7) & 0xFFFFFFFF) >> (32 - n)

    def extended(p: np.ndarray, n: np.ndarray) -> np.ndarray:
        raw = np.where(n > 0, bits(p, np.maximum(n, 1)), 0)
        return np.where((n > 0) & (raw < (1 << np.maximum(n - 1, 0))), raw - (1 << n) + 1, raw)

    lane = np.arange(len(at))
    got = dc[lane, bits(at, np.full(len(at), 16))]
    at, size = at + (got & 255), got >> 8
    diff, at = extended(at, size), at + size
    k = np.ones(len(at), np.int64)
    while len(lane):
        got = ac[lane, bits(at[lane], np.full(len(lane), 16))]
        run, size = got >> 12, got >> 8 & 15
        at[lane] += (got & 255) + size
        k[lane] += np.where((size == 0) & (run < 15), 64, run + 1)
        if (got & 255 == 0).any():
            raise ValueError("no Huffman code fits")
        lane = lane[k[lane] < 64]
    return diff, at


def thumbnails(images: list[Image]) -> list[np.ndarray]:
    """The luminance DC value of every 8x8 block (0 to 255), blocks of padding left out."""
    if not images:
        return []
    raw = np.frombuffer(b"".join(i.scan for i in images) + b"\0" * 8, np.uint8)
    begins = np.cumsum([0] + [len(i.scan) for i in images])
    ff = np.flatnonzero(raw[:-1] == 255)
    ff = ff[~np.isin(ff + 1, begins[1:])]
    stuffed, restart = ff[raw[ff + 1] == 0], ff[(raw[ff + 1] & 0xF8) == 0xD0]
    keep = np.ones(len(raw), bool)
    keep[stuffed + 1] = keep[restart] = keep[restart + 1] = False
    kept = np.concatenate([[0], np.cumsum(keep)])
    data = raw[keep].astype(np.int64)
    data = np.concatenate([data, np.zeros(8, np.int64)])
    word = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
    # Lanes: the intervals between restart markers.
    begin = np.sort(np.concatenate([begins[:-1], restart + 2]))
    owner = np.searchsorted(begins, begin, side="right") - 1
    number = np.arange(len(begin)) - np.searchsorted(owner, owner)
    geometry = []
    for i in images:
        h, v = max(c[1] for c in i.components), max(c[2] for c in i.components)
        across, down = -(-i.width // (8 * h)), -(-i.height // (8 * v))
        geometry.append((across, across * down, h, v))
    mcus = np.array([g[1] for g in geometry])[owner]
    every = np.array([i.interval or g[1] for i, g in zip(images, geometry, strict=True)])[owner]
    count = np.clip(mcus - number * every, 0, every)
    # Images that share tables and layout decode together.
    kinds: dict[tuple, int] = {}
    kind = np.array([kinds.setdefault((i.components, i.huffman), len(kinds)) for i in images])[owner]
    dc_values: list = [None] * len(images)
    for key, no in kinds.items():
        components, huffman = key[0], dict(key[1])
        pattern = [(c, huffman[t], huffman[0x10 | a]) for c, (_, h, v, t, a) in enumerate(components) for _ in range(h * v)]
        lanes = np.flatnonzero(kind == no)
        lanes = lanes[np.argsort(-count[lanes], kind="stable")]
        at, blocks = 8 * kept[begin[lanes]], count[lanes] * len(pattern)
        luma = components[0][1] * components[0][2]
        value = np.zeros((len(lanes), int(count[lanes].max(initial=0)) * luma), np.int16)
        level = np.zeros(len(lanes), np.int64)
        for step in range(int(blocks.max(initial=0))):
            live = int(np.searchsorted(-blocks, -step, side="left"))
            mcu, place = divmod(step, len(pattern))
            part, dc, ac = pattern[place]
            here = at[:live]
            peek = (word[here >> 3] >> (16 - (here & 7))) & 0xFFFF
            got = _flat_blocks(dc, ac)[peek]
            diff = (got >> 8) - 32768
            here += got & 255
            odd = np.flatnonzero(got == 0)
            if len(odd):
                tables = (np.broadcast_to(_symbols(t), (len(odd), 1 << 16)) for t in (dc, ac))
                diff[odd], at[odd] = _rest(word, here[odd], *tables)
            if part == 0:
                level[:live] += diff
                value[:live, mcu * luma + place] = level[:live]
        quantum = np.array([i.quantum for i in images])[owner[lanes]]
        value = np.clip((value * quantum[:, None] + 4) // 8 + 128, 0, 255).astype(np.uint8)
        back = np.argsort(lanes, kind="stable")
        for row, lane in zip(back.tolist(), lanes[back].tolist(), strict=True):
            own = int(owner[lane])
            if dc_values[own] is None:
                dc_values[own] = []
            dc_values[own].append(value[row, : count[lane] * luma])
    out = []
    for image, (across, total, h, v), got in zip(images, geometry, dc_values, strict=True):
        _, own_h, own_v, *_ = image.components[0]
        flat = np.concatenate(got)[: total * own_h * own_v]
        grid = flat.reshape(total // across, across, own_v, own_h).transpose(0, 2, 1, 3).reshape(total // across * own_v, across * own_h)
        out.append(grid[: -(-image.height * own_v // (8 * v)), : -(-image.width * own_h // (8 * h))])
    return out


def thumbnail_hash(thumbnail: np.ndarray) -> str:
    """64 bits: which of 8x8 sampled values exceed their mean; and a checksum of all values."""
    h, w = thumbnail.shape
    sample = thumbnail[(2 * np.arange(8) + 1) * h // 16][:, (2 * np.arange(8) + 1) * w // 16].astype(np.int64)
    above = np.packbits(sample.ravel() * 64 > sample.sum()).tobytes().hex()
    return f"{above}-{zlib.crc32(np.ascontiguousarray(thumbnail).tobytes()):08x}"


# ---- Spark steps --------------------------------------------------------------------------------------------------


def write_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as JPEG images."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=CHUNK):
            offsets, data = utf8(batch.column("text"))
            n = np.diff(offsets)
            rows = np.maximum(-(-n // ROW), 1)
            begin = ROW * (np.cumsum(rows) - rows)
            payload = np.zeros(int(rows.sum()) * ROW, np.uint8)
            payload[np.arange(len(data)) + np.repeat(begin - offsets[:-1], n)] = data
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n), pa.array(write_images(payload, rows), pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


FEATURES = "doc_id long, n_bytes long, media_bytes long, media_sha256 string, width int, height int, images int, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string"


def read_media(media: DataFrame, keep: bool = False) -> DataFrame:
    """Per row of (doc_id, n_bytes, media): sizes, the first image's dimensions, digests of all thumbnail values, feature; the thumbnail bytes if `keep`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "media", CHUNK):
            stored = batch.column("media").to_pylist()
            parsed = [parse(m) for m in stored]
            flat = iter(thumbnails([i for own in parsed for i in own]))
            rows = []
            for m, own in zip(stored, parsed, strict=True):
                small = [next(flat) for _ in own]
                read = b"".join(s.tobytes() for s in small)
                feature = f"{own[0].width}x{sum(i.height for i in own)}:{'.'.join(map(thumbnail_hash, small))}" if own else None
                row = (len(m or b""), hashlib.sha256(m or b"").hexdigest(), own[0].width if own else None, own[0].height if own else None, len(own))
                rows.append((*row, len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-64:]), feature, *[read] * keep))
            types = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)]
            names = [x.split()[0] for x in FEATURES.split(", ")] + ["thumbnail"] * keep
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *columns], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, FEATURES + ", thumbnail binary" * keep)
