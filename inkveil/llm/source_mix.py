"""Mixing sources to target weights: hash-random order within each source, distributed prefix sums, exact budgets.

Method. Every document gets a hash of its id and text as a random key. One exchange sorts the narrow rows (no texts) by source and
key over ranges, so that a source of any share spreads over as many tasks as its rows need. Each task adds up the sizes
that stand before a row in its own range; sums by (range, source) then give what stands before the range, and a row's
prefix sum is the total of both. Budgets fill up by weight: what a source may not take goes to the others in rounds, one
small aggregate a round. A source with budget b and size s is taken b // s times whole, and in one more epoch up to the word
where the prefix sum meets b mod s, so its words add up to b exactly; one document a source may be cut.

Nothing depends on the number or order of input partitions but the ranges themselves, and prefix sums do not depend on
those, so a rerun gives the same rows.

Defined results. Words are `[^\\x20\\x09-\\x0D]+`. Null or empty text: size 0, nothing taken. A null source is a source, the last one;
a null doc_id is a document. Rows of equal id and text are documents each; they stand side by side and may be taken unequally
where the budget ends between them. Sources without any word have target 0. An empty table gives no rows. Of extra columns
only those named in `keep` go along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._arrow import release
from ._shared import stash

WORD = r"[^\x20\x09-\x0D]+"


def keyed(docs: DataFrame, seed: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size (words) and a random key for each document."""
    text = F.coalesce("text", F.lit(""))
    said = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text)
    return docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.substring(F.md5(said), 1, 16).alias("key"), *([F.struct(*keep).alias("kept")] if keep else []))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds `before`, the sizes of the same source that stand earlier in this task's range."""
    last, total = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        source = batch.column("source")
        size = batch.column("size").to_numpy(zero_copy_only=False).astype(np.int64)
        code = source.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        start = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        sums = np.concatenate([[0], np.cumsum(size)])
        first = source[0].as_py()
        carried = np.zeros(len(start), np.int64)
        if first == last:  # at a task's start there is nothing to carry: total is 0
            carried[0] = total
        run = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(size))))
        before = sums[:-1] - sums[start][run] + carried[run]
        last, total = source[-1].as_py(), int(before[-1] + size[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before)], [*batch.schema.names, "before"])
    release()


def ranged(rows: DataFrame) -> DataFrame:
    """rows with `part`, their range, and `before`, written as a table."""
    order = [F.asc_nulls_last("source"), *(F.asc(c) for c in ("key", "doc_id", "size", "tie"))]
    tied = rows.withColumn("tie", F.monotonically_increasing_id())  # equal rows may lie in several ranges
    placed = tied.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie").withColumn("part", F.spark_partition_id())
    schema = T.StructType([*placed.schema.fields, T.StructField("before", T.LongType())])
    return stash(placed.mapInArrow(_summed, schema), "ranged")


def weighed(parts: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """A row for each source: source, source_size, weight and cap. parts has sums by (part, source), parts in order of sources.

    A source's number is the number of sources that begin in earlier ranges, and its place among those of its own range.
    """
    sources = parts.groupBy("source").agg(F.min("part").alias("part"), F.sum("size").alias("source_size"))
    begun = sources.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    begun = begun.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"))
    number = F.col("earlier") + F.row_number().over(Window.partitionBy("part").orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (number % len(weights) + 1).cast("int")).cast("long")
    return sources.join(begun, "part").select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("cap"))


def filled(sources: DataFrame, share: float) -> DataFrame:
    """sources with their target: cap or weight times the level at which all targets make the share of all sizes."""
    level = 0.0
    while True:
        above = F.col("weight") * F.lit(level) > F.col("cap")
        total, capped, free = sources.agg(F.sum("source_size"), F.sum(F.when(above, F.col("cap"))), F.sum(F.when(~above, F.col("weight")))).first()
        reached = (share * (total or 0) - (capped or 0)) / free if free else level
        if reached <= level:
            return sources.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(level)).alias("target"))
        level = reached


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, most: int = 3, seed: int = 13, keep: tuple[str, ...] = (), max_broadcast: int = 1 << 16) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, copies (times it is taken whole), cut (words of one more, partial copy) and keep (other names than these).

    Sources in order of code points, null last, have the weights in turn. Together they take `share` of all words, none
    more than `most` times its own. Up to max_broadcast (range, source) pairs go to every task; beyond, both sides are shuffled.
    """
    rows = ranged(stash(keyed(docs, seed, keep), "keyed"))
    parts = stash(rows.groupBy("part", "source").agg(F.sum("size").alias("size")), "parts")
    targets = filled(stash(weighed(parts, weights, most), "sources"), share)
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", "source", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("offset"))
    size = F.col("source_size")
    budget = F.least(F.floor(F.col("target") + 0.5), size * most)
    copies = F.when(size > 0, F.floor(budget / size)).otherwise(0).cast("long")
    plan = offsets.alias("o").join(targets.alias("t"), F.expr("o.source <=> t.source"))
    plan = plan.select("part", F.col("o.source").alias("from"), "offset", "source_size", "target", copies.alias("copies"), (budget - copies * size).alias("rest"))
    plan = stash(plan, "plan")
    few = plan.limit(max_broadcast + 1).count() <= max_broadcast
    joined = rows.withColumnRenamed("part", "own").join(F.broadcast(plan) if few else plan, F.expr("own = part AND source <=> from"))
    cut = F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("offset") - F.col("before")))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size") + cut).alias("taken"), "copies", cut.alias("cut"), *(["kept.*"] if keep else []))


def drawn(mixed: DataFrame, text: Column | str = "text") -> DataFrame:
    """The mix itself: (doc_id, epoch, text), a row a copy; a partial copy holds its first words, joined by one space."""
    text = F.col(text) if isinstance(text, str) else text
    whole = mixed.where("copies > 0").select("doc_id", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("epoch"), text.alias("text"))
    words = F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lit(1), F.col("cut").cast("int"))
    partial = F.when(F.col("cut") < F.col("size"), F.array_join(words, " ")).otherwise(text)
    return whole.unionByName(mixed.where("cut > 0").select("doc_id", (F.col("copies") + 1).cast("int").alias("epoch"), partial.alias("text")))
