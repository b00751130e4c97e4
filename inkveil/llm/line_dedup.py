"""Line dedup by a sharded minimal perfect hash.

Method. A line's key is the line without `[\\x20\\x09-\\x0D]` at its ends, A-Z lower-cased; its identity is a 128-bit
hash. Spark counts the documents of every distinct key (one shuffle of 24-byte rows, pre-aggregated on the map side).
Keys that reach `min_docs` are dealt into shards by hash; each shard of about `shard_keys` keys becomes one minimal
perfect hash (levels of bit arrays, a key's slot is the rank of its bit) that indexes three compact arrays: 64-bit
fingerprints, document counts and the largest document id. Documents probe these arrays: they never join lines.
The index goes to every Python worker once if its measured size is at most `max_broadcast` bytes. Beyond that the
probes travel to the shards instead: each document's line hashes, cut into bounded groups per shard, meet the shard's
arrays in a cogroup, and the verdicts return by document. Both ways give the same rows.

Defined results. Null or empty text: one empty line. Rows are documents: a repeated row counts as one more document,
and rows sharing the largest doc_id all keep their lines. A row without doc_id counts too, but keeps all its lines. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import chunks, mix
from ._shared import stash

STRIPPED = b" \t\n\x0b\x0c\r"
_U = np.uint64
_NONE = np.iinfo(np.int64).min


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The key of a line if it has at least min_chars code points."""
    if len(line) < min_chars:
        return None
    key = line.strip(STRIPPED)
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return key.lower()  # of bytes: only A-Z


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), ">u8").astype(np.uint64).reshape(-1, 2)


# ---- the minimal perfect hash -------------------------------------------------------------------------------------


def build_mph(h: np.ndarray, gamma: float = 2.0) -> tuple[list[np.ndarray], np.ndarray]:
    """Levels of packed bits and each key's slot. h: distinct uint64. A key sits in the first level where it collides with no other."""
    levels, slot = [], np.full(len(h), -1, np.int64)
    rest, base = np.arange(len(h)), 0
    while len(rest):
        size = max(64, int(gamma * len(rest)) + 63 & ~63)
        at = (mix(h[rest] + _U(len(levels) * 0x9E3779B97F4A7C15 % (1 << 64))) % _U(size)).astype(np.int64)
        bits = np.bincount(at, minlength=size) == 1
        alone = bits[at]
        rank = np.cumsum(bits) - 1
        slot[rest[alone]] = base + rank[at[alone]]
        base += int(bits.sum())
        levels.append(np.packbits(bits))
        rest = rest[~alone]
    return levels, slot


class Shard:
    """One perfect hash with its arrays, as probed."""

    def __init__(self, levels: list[np.ndarray], prints: np.ndarray, counts: np.ndarray, last: np.ndarray):
        self.bits = [np.unpackbits(x).astype(bool) for x in levels]
        self.ranks, base = [], 0
        for bits in self.bits:
            self.ranks.append(np.cumsum(bits) - 1 + base)
            base += int(bits.sum())
        self.prints, self.counts, self.last = prints, counts, last

    def probe(self, h: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document count (0: no such line) and largest document of each hash."""
        slot, rest = np.full(len(h), -1, np.int64), np.arange(len(h))
        for level, bits in enumerate(self.bits):
            at = (mix(h[rest] + _U(level * 0x9E3779B97F4A7C15 % (1 << 64))) % _U(len(bits))).astype(np.int64)
            hit = bits[at]
            slot[rest[hit]] = self.ranks[level][at[hit]]
            rest = rest[~hit]
        known = slot >= 0
        known[known] = self.prints[slot[known]] == prints[known]
        count, last = np.zeros(len(h), np.int64), np.full(len(h), _NONE, np.int64)
        count[known], last[known] = self.counts[slot[known]], self.last[slot[known]]
        return count, last

    @staticmethod
    def of(row) -> Shard:
        sizes, packed = np.frombuffer(row["sizes"], np.int32), np.frombuffer(row["levels"], np.uint8)
        levels = np.split(packed, np.cumsum(sizes)[:-1])
        return Shard(levels, np.frombuffer(row["prints"], np.uint64), np.frombuffer(row["counts"], np.int32), np.frombuffer(row["last"], np.int64))


INDEX_SCHEMA = "shard int, sizes binary, levels binary, prints binary, counts binary, last binary"


def _index_shard(frame: pd.DataFrame) -> pd.DataFrame:
    """Keys whose first 64 bits agree (none in practice) keep the first in a slot; the others form further shards' rows."""
    rows, rest = [], frame
    while len(rest):
        h = rest["h1"].to_numpy(np.int64).view(np.uint64)
        _, first = np.unique(h, return_index=True)
        now = rest.iloc[first]
        levels, slot = build_mph(h[first])
        order = np.argsort(slot)
        rows.append(
            {
                "shard": int(frame["shard"].iloc[0]),
                "sizes": np.array([len(x) for x in levels], np.int32).tobytes(),
                "levels": b"".join(x.tobytes() for x in levels),
                "prints": now["h2"].to_numpy(np.int64)[order].tobytes(),
                "counts": np.minimum(now["n"].to_numpy(np.int64)[order], 2**31 - 1).astype(np.int32).tobytes(),
                "last": now["last"].fillna(_NONE).to_numpy(np.int64)[order].tobytes(),
            }
        )
        rest = rest.drop(rest.index[first])
    return pd.DataFrame(rows, columns=["shard", "sizes", "levels", "prints", "counts", "last"])


def _shard_of(h1: np.ndarray, shards: int) -> np.ndarray:
    return (mix(h1 ^ _U(0x5851F42D4C957F2D)) % _U(shards)).astype(np.int32)


# ---- Spark steps --------------------------------------------------------------------------------------------------


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, doc_id, n): each key of each row once, summed up per chunk of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            keys: dict[bytes, list] = {}
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                own = {k for line in (text or b"").split(b"\n") if (k := line_key(line, min_chars)) is not None}
                for k in own:
                    at = keys.setdefault(k, [0, None])
                    at[0] += 1
                    at[1] = doc if at[1] is None or doc is not None and doc > at[1] else at[1]
            if keys:
                h = _hashes(list(keys)).view(np.int64)
                n, last = zip(*keys.values(), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(last, pa.int64()), pa.array(n, pa.int64())], ["h1", "h2", "last", "n"])

    return docs.select("doc_id", "text").mapInArrow(run, "h1 long, h2 long, last long, n long")


def frequent_lines(docs: DataFrame, min_docs: int = 5, min_chars: int = 40) -> DataFrame:
    """(h1, h2, n, last) of the keys found in at least min_docs documents."""
    return line_hashes(docs, min_chars).groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("last").alias("last")).where(F.col("n") >= min_docs)


def build_index(lines: DataFrame, shards: int) -> DataFrame:
    """One row of arrays for each shard of the (h1, h2, n, last) rows."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("shard", pa.array(_shard_of(b.column("h1").to_numpy().view(np.uint64), shards)))

    dealt = lines.select("h1", "h2", "n", "last").mapInArrow(deal, "h1 long, h2 long, n long, last long, shard int")
    return dealt.groupBy("shard").applyInPandas(_index_shard, INDEX_SCHEMA)


class Index:
    """All shards, as a worker holds them."""

    def __init__(self, rows: list[dict], shards: int):
        self.shards = shards
        self.at: dict[int, list[Shard]] = {}
        for r in rows:
            self.at.setdefault(int(r["shard"]), []).append(Shard.of(r))

    def probe(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count, last = np.zeros(len(h), np.int64), np.full(len(h), _NONE, np.int64)
        shard = _shard_of(h[:, 0], self.shards)
        for s in np.unique(shard):
            own = np.flatnonzero(shard == s)
            for x in self.at.get(int(s), ()):
                c, m = x.probe(h[own, 0], h[own, 1])
                hit = c > 0
                count[own[hit]], last[own[hit]] = c[hit], m[hit]
        return count, last


OUT = "doc_id long, n_lines long, n_dropped long, kept_text string, kept_sha256 string"


def _result(rows: list[tuple], with_text: bool) -> pa.RecordBatch:
    doc, n, dropped, kept = zip(*rows, strict=True)
    text = pa.array(kept, pa.binary()).cast(pa.string()) if with_text else pa.nulls(len(kept), pa.string())
    return pa.RecordBatch.from_arrays(
        [pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), text, pa.array([hashlib.sha256(k).hexdigest() for k in kept])],
        ["doc_id", "n_lines", "n_dropped", "kept_text", "kept_sha256"],
    )


def _keyed(batch: pa.RecordBatch, min_chars: int) -> tuple[list[list[bytes]], list[tuple[int, int]], np.ndarray]:
    """Lines of each row, (row, line) of each keyed line, their hashes."""
    lines = [(t or b"").split(b"\n") for t in batch.column("text").cast(pa.binary()).to_pylist()]
    where, keys = [], []
    for r, own in enumerate(lines):
        for i, line in enumerate(own):
            if (k := line_key(line, min_chars)) is not None:
                where.append((r, i))
                keys.append(k)
    return lines, where, _hashes(keys) if keys else np.zeros((0, 2), np.uint64)


def _drop(lines: list[bytes], gone: set[int]) -> bytes:
    return b"\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else b"\n".join(lines)


def dedup_lines(docs: DataFrame, min_docs: int = 5, min_chars: int = 40, shard_keys: int = 1 << 16, max_broadcast: int = 32 << 20, with_text: bool = True) -> DataFrame:
    """Per row: doc_id, n_lines, n_dropped, kept_text (null unless with_text), kept_sha256."""
    spark = docs.sparkSession
    lines = stash(frequent_lines(docs, min_docs, min_chars), "lines")
    shards = max(1, -(-lines.count() // shard_keys))
    index = stash(build_index(lines, shards), "line-index")
    size = index.agg(F.sum(sum(F.length(c) for c in ("sizes", "levels", "prints", "counts", "last")))).first()[0] or 0
    if size > max_broadcast:
        return _routed(docs, index, shards, min_chars, with_text)
    sent = spark.sparkContext.broadcast(([r.asDict() for r in index.collect()], shards))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Index(*sent.value)
        for batch in chunks(batches):
            own, where, h = _keyed(batch, min_chars)
            docs_ = batch.column("doc_id").to_pylist()
            count, last = found.probe(h)
            gone: dict[int, set[int]] = {}
            for i in np.flatnonzero(count):
                r, line = where[i]
                if docs_[r] is not None and docs_[r] != last[i]:
                    gone.setdefault(r, set()).add(line)
            yield _result([(d, len(x), len(g := gone.get(r, ())), _drop(x, g)) for r, (d, x) in enumerate(zip(docs_, own, strict=True))], with_text)

    return docs.select("doc_id", "text").mapInArrow(run, OUT)


# ---- the way without a broadcast ----------------------------------------------------------------------------------


def _routed(docs: DataFrame, index: DataFrame, shards: int, min_chars: int, with_text: bool, group_probes: int = 1 << 20) -> DataFrame:
    """Probes travel to the shards in groups of about group_probes; verdicts come back by document."""

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            _, where, h = _keyed(batch, min_chars)
            if not where:
                continue
            doc = batch.column("doc_id").to_pylist()
            shard = _shard_of(h[:, 0], shards)
            row, line = np.array(where, np.int32).T
            order = np.lexsort((row, shard))
            cut = np.flatnonzero(np.diff(shard[order].astype(np.int64) * len(doc) + row[order])) + 1
            parts = [p for p in np.split(order, cut) if doc[row[p[0]]] is not None]
            if not parts:
                continue
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(shard[p[0]]) for p in parts], pa.int32()), pa.array([doc[row[p[0]]] for p in parts], pa.int64())]
                + [pa.array([f(p) for p in parts], pa.binary()) for f in (lambda p: line[p].astype(np.int32).tobytes(), lambda p: h[p].tobytes())],
                ["shard", "doc_id", "line", "h"],
            )

    sent = stash(docs.select("doc_id", "text").mapInArrow(probes, "shard int, doc_id long, line binary, h binary"), "probes")
    sizes = sent.groupBy("shard").agg(F.ceil(F.sum(F.length("line")) / (4 * group_probes)).cast("int").alias("groups"))
    salted = sent.join(sizes, "shard").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("groups")).cast("int")).drop("groups")
    copies = index.join(sizes, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")

    def judge(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found, out = [Shard.of(r) for r in right.to_dict("records")], []
        for doc, line, h in zip(left["doc_id"], left["line"], left["h"], strict=True):
            hs, at = np.frombuffer(h, np.uint64).reshape(-1, 2), np.frombuffer(line, np.int32)
            for x in found:
                count, last = x.probe(hs[:, 0], hs[:, 1])
                out += [(doc, int(i)) for i in at[(count > 0) & (last != doc)]]
        return pd.DataFrame(out, columns=["doc_id", "line"])

    gone = salted.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInPandas(judge, "doc_id long, line int")
    per_doc = gone.distinct().groupBy("doc_id").agg(F.collect_list("line").alias("gone"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            rows = []
            for doc, text, gone_ in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("gone").to_pylist(), strict=True):
                own = (text or b"").split(b"\n")
                rows.append((doc, len(own), len(gone_ or ()), _drop(own, set(gone_ or ()))))
            yield _result(rows, with_text)

    return docs.select("doc_id", "text").join(per_doc, "doc_id", "left").mapInArrow(apply, OUT)
