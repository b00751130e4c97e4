"""Removal of long word spans that occur earlier in the corpus, by a compacted de Bruijn graph.

Method. A window of `width` words is an edge from its first to its last words; the `anchor`-word k-mers are the nodes.
Each window belongs to the node of smallest hash among the k-mers in it, a choice that equal windows share. Windows
of one document in a row with one node form a path, which is one row: (node, hash of all its words, document, first
word, number of windows). One shuffle by node then tells, for every path, whether the same path starts earlier, and
whether its node branches, i.e. has paths of different words. A path that repeats is compacted: the whole of it is one
span with its source's coordinate. Only at branching nodes, and where a path meets itself, the first path of each kind is taken apart into its windows
(a join with the documents), and one more shuffle by window finds those that start earlier. Node and path, and the two
hashes of a window, make 128 bits. A span is used only if its source's coordinate stands before its own. Equal rows
within a chunk of documents meet before the shuffle, so a passage of a third of all documents sends a row a chunk.

Words are `[^\\x20\\x09-\\x0D]+`, unchanged. Windows are judged on the input.

Defined results. Null or empty texts, and texts shorter than the window: nothing to remove. doc_id identifies a
document: repeated rows count as one, and each loses the same words. Rows without doc_id are no sources and lose
nothing. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._arrow import Words, chunks, mix
from ._shared import stash

_U = np.uint64


def _least(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` values in a row, by doubling."""
    have, size = a, 1
    while size * 2 <= width:
        have, size = np.minimum(have[:-size], have[size:]), size * 2
    return np.minimum(have[: len(have) - (width - size)], have[width - size :]) if size < width else have


def _firsts(keys: tuple[np.ndarray, ...], doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row, the row of equal keys with the smallest (doc, at); and whether it is that itself (or repeats it)."""
    order = np.lexsort((at, doc, *keys))
    new = np.ones(len(order), bool)
    same = np.ones(len(order) - 1, bool) if len(order) else np.zeros(0, bool)
    for k in keys:
        same &= k[order][1:] == k[order][:-1]
    new[1:] = ~same
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    first = np.empty(len(order), np.int64)
    first[order] = head
    return first, (doc[first] == doc) & (at[first] == at)


PATHS = "k1 long, k2 long, known boolean, loops boolean, doc_id long, at int, n int, from_doc long, from_at int"


def _rows(k1: np.ndarray, k2: np.ndarray, loops: np.ndarray, doc: np.ndarray, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Rows for the shuffle: known repeats carry their source and are spread by a key of their own."""
    first, own = _firsts((k1, k2), doc, at)
    keep = own & (first == np.arange(len(first))) | ~own
    spread = mix(k1 ^ doc.astype(np.uint64) * _U(0x9E3779B97F4A7C15) ^ at.astype(np.uint64))
    k1 = np.where(own, k1, spread)
    columns = (k1.view(np.int64), k2.view(np.int64), ~own, loops, doc, at.astype(np.int32), n.astype(np.int32), doc[first], at[first].astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], [x.split()[0] for x in PATHS.split(", ")])


def _loops(window: np.ndarray, starts: np.ndarray, n: np.ndarray, most: int) -> np.ndarray:
    """Whether a path meets one of its windows twice. Where its node stands once, it has `most` windows or fewer."""
    path = np.cumsum(starts) - 1
    out = n > most
    for step in range(1, most):
        again = np.flatnonzero((window[step:] == window[:-step]) & (path[step:] == path[:-step]))
        out[path[again]] |= n[path[again]] > step
    return out


def _identified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        ids = batch.column("doc_id")
        yield batch.filter(ids.is_valid()) if ids.null_count else batch


def paths(docs: DataFrame, width: int, anchor: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _identified(batches):
            words = Words(batch.column("text"))
            whole = words.whole(width)
            if not whole.any():
                continue
            node = _least(words.windows(anchor), width - anchor + 1)
            turn = np.ones(len(node) + 1, bool)
            turn[1:-1] = (node[1:] != node[:-1]) | ~whole[1:] | ~whole[:-1]
            start, last = np.flatnonzero(whole & turn[:-1]), np.flatnonzero(whole & turn[1:])
            row = words.row[start]
            doc = batch.column("doc_id").to_numpy().astype(np.int64)[row]
            yield _rows(node[start], words.spans(start, last + width, seed=1), _loops(words.windows(width), whole & turn[:-1], last - start + 1, width - anchor + 1), doc, start - words.first[row], last - start + 1)

    return docs.select("doc_id", "text").mapInArrow(run, PATHS)


def _windows(asked: DataFrame, width: int) -> DataFrame:
    """The single windows of the asked-for paths: asked has doc_id, text and arrays at, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            words = Words(batch.column("text"))
            at, n = batch.column("at"), batch.column("n")
            lists = np.diff(at.offsets.to_numpy())
            row = np.repeat(np.arange(batch.num_rows), lists)
            at, n = at.flatten().to_numpy().astype(np.int64), n.flatten().to_numpy().astype(np.int64)
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at, row = np.repeat(at, n) + inner, np.repeat(row, n)
            inside = at + width <= words.count[row]  # all, unless rows of one doc_id differ
            at, row = at[inside], row[inside]
            here = at + words.first[row]
            doc = batch.column("doc_id").to_numpy().astype(np.int64)[row]
            if len(here):
                ones = np.ones(len(at), np.int64)
                yield _rows(words.windows(width)[here], words.windows(width, seed=1)[here], ones == 0, doc, at, ones)

    return asked.mapInArrow(run, PATHS)


def _judged(rows: DataFrame) -> DataFrame:
    """rows with their source if that stands before them, and whether their k1 has several k2."""
    by_key = Window.partitionBy("k1", "k2").orderBy("doc_id", "at")
    by_node = Window.partitionBy("k1")
    source = [F.first(c).over(by_key).alias(f"first_{c}") for c in ("doc_id", "at")]
    out = rows.repartition("k1").select("*", *source).withColumn("branching", F.min("k2").over(by_node) != F.max("k2").over(by_node))
    earlier = (F.col("first_doc_id") < F.col("doc_id")) | (F.col("first_doc_id") == F.col("doc_id")) & (F.col("first_at") < F.col("at"))
    return out.select(
        "doc_id", "at", "n", (F.col("known") | earlier).alias("repeats"), (F.col("branching") | F.col("loops")).alias("branching"),
        F.when(F.col("known"), F.col("from_doc")).otherwise(F.col("first_doc_id")).alias("from_doc"),
        F.when(F.col("known"), F.col("from_at")).otherwise(F.col("first_at")).alias("from_at"),
    )


def repeated_spans(docs: DataFrame, width: int = 20, anchor: int = 6) -> DataFrame:
    """(doc_id, at, n, from_doc, from_at): the n windows from word `at` on start earlier too; together all such windows.

    A known repeat's source is the first in its chunk; any other's is the first of all.
    """
    judged = _judged(paths(docs, width, anchor)).where("repeats or branching")
    judged = stash(judged.select("repeats", "doc_id", "at", "n", "from_doc", "from_at"), "paths")
    asked = judged.where("not repeats").groupBy("doc_id").agg(F.collect_list("at").alias("at"), F.collect_list("n").alias("n"))
    windows = _windows(docs.select("doc_id", "text").join(asked, "doc_id"), width)
    single = _judged(windows).where("repeats")
    columns = ["doc_id", "at", "n", "from_doc", "from_at"]
    return judged.where("repeats").select(columns).unionByName(single.select(columns))


OUT = "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string"


def remove_repeats(docs: DataFrame, width: int = 20, anchor: int = 6, with_text: bool = True) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_text (each kept word with the white space before it; null unless with_text), kept_sha256."""
    spans = repeated_spans(docs, width, anchor)
    earlier = (F.col("from_doc") < F.col("doc_id")) | (F.col("from_doc") == F.col("doc_id")) & (F.col("from_at") < F.col("at"))
    per_doc = spans.where(earlier).groupBy("doc_id").agg(F.collect_list("at").alias("at"), F.collect_list("n").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            words = Words(batch.column("text"), hashes=False)
            at, n = batch.column("at"), batch.column("n")
            row = np.repeat(np.arange(batch.num_rows), np.diff(at.offsets.to_numpy()))
            at, n = at.flatten().to_numpy().astype(np.int64), n.flatten().to_numpy().astype(np.int64)
            count = words.count[row]
            start = words.first[row] + np.minimum(at, count)
            stop = words.first[row] + np.minimum(at + n + width - 1, count)
            depth = np.bincount(start, minlength=len(words) + 1) - np.bincount(stop, minlength=len(words) + 1)
            gone = np.cumsum(depth)[: len(words)] > 0
            # Bytes that go: from the end of the word before (or the text's start) to the end of each removed word.
            before = np.concatenate([[0], words.stop])[: len(words)]
            before = np.maximum(before, words.offsets[words.row])
            size = len(words.data) + 1
            out = np.cumsum(np.bincount(before[gone], minlength=size) - np.bincount(words.stop[gone], minlength=size))[:-1] > 0
            left = words.data[~out].tobytes()
            ends = np.concatenate([[0], np.cumsum(~out)])[words.offsets]
            kept = [left[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            removed = np.bincount(words.row[gone], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(words.count.astype(np.int64)),
                    pa.array(removed.astype(np.int64)),
                    pa.array(kept, pa.binary()).cast(pa.string()) if with_text else pa.nulls(len(kept), pa.string()),
                    pa.array([hashlib.sha256(b" ".join(k.split())).hexdigest() for k in kept]),  # bytes split at the same white space
                ],
                [x.split()[0] for x in OUT.split(", ")],
            )

    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(per_doc, "doc_id", "left")
    none = F.array().cast("array<int>")
    return joined.select("doc_id", "text", F.coalesce("at", none).alias("at"), F.coalesce("n", none).alias("n")).mapInArrow(run, OUT)
