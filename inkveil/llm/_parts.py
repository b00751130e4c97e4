"""Token ids of texts, part by part: what stands between spaces is encoded once and kept, texts are put together by Arrow."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

KEPT_PARTS = 400_000
PART_CHUNK = 1 << 20  # bytes of text at a time: a part that occurs twice in it is looked up once


class PartIds:
    """Ids of parts as little-endian uint32 bytes. Two generations of at most `most` new parts each bound what a worker keeps."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], most: int = KEPT_PARTS):
        self.encode, self.most = encode, most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.asked = self.missed = 0

    def of(self, parts: list[str]) -> list[bytes]:
        out = list(map(self.young.get, parts))
        new = []
        for i in [i for i, v in enumerate(out) if v is None]:
            v = self.old.get(parts[i])
            if v is None:
                new.append(i)
            else:
                out[i] = self.young[parts[i]] = v
        self.asked, self.missed = self.asked + len(parts), self.missed + len(new)
        for i, v in zip(new, self.encode([parts[i] for i in new]), strict=True):
            out[i] = self.young[parts[i]] = v
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        return out


def strings(column: pa.Array) -> list[str]:
    """As to_pylist(), several times faster."""
    return column.to_numpy(zero_copy_only=False).tolist()


def rows(texts: pa.Array, rest: PartIds, heads: PartIds | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row (uint32), and where each text's begin and end. `heads` has the parts that no space stands before."""
    lists = pc.split_pattern(texts, " ")
    coded = lists.flatten().dictionary_encode()
    ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    names = strings(coded.dictionary)
    if heads is None:
        known = pa.array(rest.of(names), pa.binary())
    else:
        first = ends[:-1]
        used = np.zeros(len(names), bool)
        inner = np.ones(len(at), bool)
        inner[first] = False
        used[at[inner]] = True
        own = np.flatnonzero(used)
        begin = coded.dictionary.take(pa.array(at[first])).dictionary_encode()
        known = pa.array(rest.of([names[i] for i in own.tolist()]) + heads.of(strings(begin.dictionary)), pa.binary())
        place = np.cumsum(used) - 1
        at = place[at]
        at[first] = len(own) + begin.indices.to_numpy(zero_copy_only=False)
    flat = known.take(pa.array(at))
    _, offsets, data = flat.buffers()
    bounds = np.frombuffer(offsets, np.int32)[flat.offset : flat.offset + len(flat) + 1].astype(np.int64)[ends] // 4
    ids = np.frombuffer(data, "<u4") if data is not None else np.zeros(0, "<u4")
    return ids, bounds


def taken(table: pa.BinaryArray, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The bytes that `table` has for each id, one after the other, and where each begins and ends."""
    flat = table.take(pa.array(ids.astype(np.int64)))
    _, offsets, data = flat.buffers()
    at = np.frombuffer(offsets, np.int32)[flat.offset : flat.offset + len(flat) + 1].astype(np.int64)
    return memoryview(data) if data is not None else memoryview(b""), at
