"""Best-fit packing of tokenized documents into sequences of fixed capacity.

Method: hierarchical residual packing. Every input partition tokenizes its documents, cuts those that are longer than
the capacity, and packs its pieces by best fit in decreasing order. Bins filled to `full` tokens or more are final. The
others go up the tree as items: each round deals them into groups of at most `group_bins`, packs every group by best
fit again, and emits what is full by then, until one bounded group remains or a round joins hardly any two bins. An
item's place in its outermost bin is the sum of its offsets on the way up. No task ever holds more than its own input
partition's piece lengths or one bounded group.

Defined results. Null text: empty; an empty document is its end id alone. Repeated rows are packed once each. Extra
columns are ignored. The tokenizer file is read by path on each worker; special-token strings in a text are ordinary
text.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import chunks, held, release
from ._parts import PART_CHUNK, PartIds, rows
from ._shared import stash

# Parts whose number of words for the tokenizer is certain: runs of Latin letters, single digits, runs of marks, line ends.
_LETTERS, _MARKS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", r"!\"#$%&()*+,\-./:;=?@\[\]^_{}~"
_PLAIN = re.compile(rf"[{_LETTERS}0-9{_MARKS}\n]*[{_LETTERS}0-9{_MARKS}]")
_WORDS = re.compile(rf"[{_LETTERS}]+|[0-9]|[{_MARKS}]+")


class WordIds(PartIds):
    """Ids of what stands between two spaces: the tokenizer drops white space and never joins over a space.

    Plain parts are encoded in a row; a part has as many word ends as it has words, which tells them apart.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(self.tokenizer.model.end_of_word_suffix or "")]] = True
        super().__init__(self._ids)

    def _each(self, parts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _ids(self, parts: list[str], together: int = 512) -> list[bytes]:
        out: list = [None] * len(parts)
        plain = [i for i, p in enumerate(parts) if _PLAIN.fullmatch(p)]
        groups = [plain[k : k + together] for k in range(0, len(plain), together)]
        texts = [" ".join([parts[i] for i in g]) for g in groups]
        for g, e in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            words = np.cumsum([1 if parts[i].isalpha() else len(_WORDS.findall(parts[i])) for i in g])
            if len(stops) != words[-1] or stops[-1] != len(ids):
                continue
            raw, start = ids.tobytes(), 0
            for i, stop in zip(g, (4 * stops[words - 1]).tolist(), strict=True):
                out[i], start = raw[start:stop], stop
        left = [i for i, v in enumerate(out) if v is None]
        for i, v in zip(left, self._each([parts[i] for i in left]), strict=True):
            out[i] = v
        return out

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin and end."""
        return rows(texts.fill_null(""), self)


def coder(path: str) -> WordIds:
    return held(("words", path), lambda: WordIds(path))


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and each bin's fill. Longest items first; each goes to the fullest bin that takes it."""
    bins, offsets, fill = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit s: there is a bin with s tokens to spare
    sizes = lengths.tolist()
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = sizes[i]
        fits = some >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            at = by_space[space].pop()
            if not by_space[space]:
                some ^= 1 << space
        else:
            space, at = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = at, fill[at]
        fill[at] += size
        by_space[space - size].append(at)
        some |= 1 << (space - size)
    return bins, offsets, np.array(fill, np.int64)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, at long, fill long"


def pack_partitions(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, ids: bool = False) -> DataFrame:
    """The pieces of each input partition, packed among themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = coder(tokenizer), np.array([end_id], "<u4").tobytes()
        part, found, kept = 0, [], []
        for batch in chunks(batches, limit=PART_CHUNK):
            part = batch.column("part")[0].as_py()
            coded, bounds = words.texts(batch.column("text"))
            n = np.diff(bounds) + 1
            pieces = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(n[row] - start, capacity)
            raw = memoryview(coded).cast("B") if len(coded) else memoryview(b"")
            first = bounds[:-1][row] + start
            last = start + length == n[row]
            crc = np.empty(len(row), np.int64)
            for i, (a, b, ended) in enumerate(zip((4 * first).tolist(), (4 * (first + length - last)).tolist(), last.tolist(), strict=True)):
                crc[i] = zlib.crc32(end, zlib.crc32(raw[a:b])) if ended else zlib.crc32(raw[a:b])
                if ids:
                    kept.append(bytes(raw[a:b]) + (end if ended else b""))
            found.append((batch.column("doc_id").cast(pa.int64()).take(pa.array(row)), piece.astype(np.int32), start, length, crc))
        release()
        if not found:
            return
        doc = pa.concat_arrays([f[0] for f in found])
        piece, start, length, crc = (np.concatenate([f[k] for f in found]) for k in range(1, 5))
        bins, at, fill = best_fit(length, capacity)
        out = [doc, *map(pa.array, (piece, start, length, crc, bins + (part << 33), at, fill[bins]))] + ([pa.array(kept, pa.binary())] if ids else [])
        names = [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * ids
        table = pa.RecordBatch.from_arrays(out, names)
        for k in range(0, table.num_rows, 10_000):
            yield table.slice(k, 10_000)

    with_part = docs.select("doc_id", "text", F.spark_partition_id().cast("long").alias("part"))
    return with_part.mapInArrow(run, PIECES + ", ids binary" * ids)


def merge_round(capacity: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def merge(items: pd.DataFrame) -> pd.DataFrame:
        """One group's bins (bin, fill, members) as items of a further best fit; a merged bin has its first item's number."""
        items = items.sort_values(["fill", "bin"], ascending=[False, True], ignore_index=True)
        bins, at, fill = best_fit(items["fill"].to_numpy(np.int64), capacity)
        _, first = np.unique(bins, return_index=True)
        return pd.DataFrame(
            {"inner": items["inner"], "inner_at": items["inner_at"] + at, "bin": items["bin"].to_numpy()[first][bins], "fill": fill[bins]}
        )

    return merge


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, full: int | None = None, group_bins: int = 4096, ids: bool = False
) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and the ids (uint32) if asked for."""
    full = capacity - capacity // 128 if full is None else full
    pieces = stash(pack_partitions(docs, tokenizer, capacity, end_id, ids), "pieces")
    # A row per open bin: what it was at first (inner), where that stands in it, its number and fill by now.
    open_bins = pieces.where(F.col("fill") < full).groupBy("bin").agg(F.first("fill").alias("fill"))
    moved = open_bins.select(F.col("bin").alias("inner"), F.lit(0).cast("long").alias("inner_at"), "bin", "fill")
    done: list[DataFrame] = []
    n = moved.count()
    for turn in count():
        if not n:
            break
        groups = -(-n // group_bins)
        outer = moved.groupBy("bin").agg(F.first("fill").alias("fill")).select("bin", "fill", F.col("bin").alias("inner"), F.lit(0).cast("long").alias("inner_at"))
        dealt = outer.withColumn("group", F.pmod(F.xxhash64("bin", F.lit(turn)), F.lit(groups)))
        merged = dealt.groupBy("group").applyInPandas(merge_round(capacity), "inner long, inner_at long, bin long, fill long")
        step = merged.select(F.col("inner").alias("bin"), F.col("inner_at").alias("step_at"), F.col("bin").alias("to"), F.col("fill").alias("to_fill"))
        moved = stash(
            moved.drop("fill").join(step, "bin").select("inner", (F.col("inner_at") + F.col("step_at")).alias("inner_at"), F.col("to").alias("bin"), F.col("to_fill").alias("fill")),
            f"bins-{turn}",
        )
        done.append(moved.where(F.col("fill") >= full))
        left = moved.where(F.col("fill") < full)
        m = left.select("bin").distinct().count()
        last = groups == 1 or m > 0.98 * n
        moved, n = left, 0 if last else m
        if last:
            done.append(left)
    places = None
    for d in done:
        places = d if places is None else places.unionByName(d)
    if places is None:
        return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), F.col("at").alias("offset"), *["ids"] * ids)
    places = places.select(F.col("inner").alias("bin"), "inner_at", F.col("bin").alias("outer"))
    return pieces.join(places, "bin", "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.coalesce("outer", "bin").alias("sequence_id"), (F.col("at") + F.coalesce("inner_at", F.lit(0))).alias("offset"), *["ids"] * ids,
    )
