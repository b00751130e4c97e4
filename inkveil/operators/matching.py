"""Joins by value without a common key: the nearest price bracket of a target, and candidates that break none of a set's constraints.

Both cut values into buckets at quantiles of the data, so that rows meet by bucket; equal values meet once, whatever number of rows has them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values ---
ABOVE, BEYOND = 1.3, 1.15  # how far a limit may lie above the target, and the target above a range's end
# --- end of fixed values ---


def _bounds(values: DataFrame, buckets: int) -> Column:
    """Bucket bounds of the column `value`, at most `buckets` numbers, as a constant array."""
    found = values.agg(F.percentile_approx("value", [i / buckets for i in range(1, buckets)])).first()[0] or []
    return F.array(*[F.lit(float(b)) for b in sorted(set(found))]).cast("array<double>")


def _bucket(bounds: Column, value: Column) -> Column:
    return F.size(F.filter(bounds, lambda b: b <= value))


def _covering(ranges: DataFrame, buckets: int) -> DataFrame:
    """(value, at, after): at each end of a range (low, end, high, pos, bracket_id), the range of the smallest high that covers this end, and the stretch up to the next.

    Ends and stretches are numbered in order. A range is as many nodes of a binary tree over these numbers as the tree has levels, at most twice; a number
    finds its ranges at the nodes above it. So ranges that overlap are never paired off with what they cover.
    """
    ends = ranges.select(F.col("low").alias("value")).unionByName(ranges.select(F.col("end").alias("value"))).distinct()
    rows = ends.withColumn("bucket", _bucket(_bounds(ends, buckets), F.col("value")))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"))
    before = sizes.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before"))  # one row a bucket
    own = F.row_number().over(Window.partitionBy("bucket").orderBy("value"))
    ranked = rows.withColumn("own", own).join(F.broadcast(before), "bucket").select("value", (2 * (F.col("before") + F.col("own") - 1)).cast("long").alias("no"))
    levels = F.sequence(F.lit(0), F.lit((2 * ends.count() + 2).bit_length()))
    placed = ranges.join(ranked.select(F.col("value").alias("low"), F.col("no").alias("lo")), "low").join(ranked.select(F.col("value").alias("end"), F.col("no").alias("hi")), "end")
    node = lambda level, no: F.struct(level.alias("level"), no.alias("node"))
    none = F.array().cast("array<struct<level:int,node:bigint>>")

    def up(a: Column, level: Column) -> Column:
        low, high = (a["lo"] <= a["hi"]) & (a["lo"] % 2 == 1), (a["lo"] <= a["hi"]) & (a["hi"] % 2 == 0)
        out = F.concat(a["out"], F.when(low, F.array(node(level, a["lo"]))).otherwise(none), F.when(high, F.array(node(level, a["hi"]))).otherwise(none))
        lo, hi = a["lo"] + low.cast("long"), a["hi"] - high.cast("long")
        # What has crossed stays so: halves of neighbours may be equal again.
        return F.struct(F.shiftright(lo, 1).alias("lo"), F.when(lo <= hi, F.shiftright(hi, 1)).otherwise(F.lit(-1).cast("long")).alias("hi"), out.alias("out"))

    nodes = F.aggregate(levels, F.struct("lo", "hi", none.alias("out")), up, lambda a: a["out"])
    best = F.struct(F.col("high").alias("limit"), "pos", "bracket_id")
    held = placed.select(best.alias("best"), F.explode(nodes).alias("k")).select("best", "k.*").groupBy("level", "node").agg(F.min("best").alias("best"))
    asked = ranked.select("value", "no", F.explode(F.array(F.lit(0), F.lit(1))).alias("side")).select("value", "side", (F.col("no") + F.col("side")).alias("no"), F.explode(levels).alias("level"))
    asked = asked.select("value", "side", "level", F.expr("shiftright(no, level)").alias("node"))
    return asked.join(held, ["level", "node"]).groupBy("value").agg(*[F.min(F.when(F.col("side") == i, F.col("best"))).alias(name) for i, name in enumerate(("at", "after"))])


def nearest_bracket(targets: DataFrame, brackets: DataFrame, buckets: int = 64) -> DataFrame:
    """targets (value and others) with bracket_id and diff of the nearest bracket that fits, null where none does.

    brackets: (bracket_id, pos, low, high). Without low it is a limit, which fits up to ABOVE times the target; else a range, which fits
    from its low to BEYOND times its high. The distance is to the limit or the high; equal distances go to the smaller pos, then bracket_id.
    A target sees the next limit below and above, the next high of a range below, and the end of a range before it, which knows what covers the target:
    all come from one sorted union in its bucket, or from the buckets before and after.
    """
    values = targets.where("value IS NOT NULL").select(F.col("value").cast("double").alias("value")).distinct()
    own = brackets.where("high IS NOT NULL").select("bracket_id", "pos", F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"))
    bounds = _bounds(values, buckets)
    ranges = own.where("low <= high").withColumn("end", F.least("high", F.col("high") * BEYOND))
    firsts = lambda df, name: df.groupBy(F.col("high").alias("value")).agg(F.min(F.struct("pos", "bracket_id")).alias("first")).select("value", F.struct(F.col("value").alias("limit"), "first.pos", "first.bracket_id").alias(name))
    covering = _covering(ranges.where("low <= end"), buckets).select("value", F.struct("value", "at", "after").alias("cover"))
    marks = firsts(own.where("low IS NULL"), "limit").unionByName(firsts(ranges, "top"), allowMissingColumns=True).unionByName(covering, allowMissingColumns=True)
    marks = marks.withColumn("bucket", _bucket(bounds, F.col("value"))).withColumn("asks", F.lit(False))
    both = marks.unionByName(values.withColumn("bucket", _bucket(bounds, F.col("value"))).withColumn("asks", F.lit(True)), allowMissingColumns=True)
    names = ["limit", "top", "cover"]
    up, down = Window.partitionBy("bucket").orderBy("value", "asks"), Window.partitionBy("bucket").orderBy(F.desc("value"), F.desc("asks"))
    # Frames that begin at the first row only: one that ends at the last row is computed anew at each.
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    near = both.select("value", "bucket", "asks", *names, *[F.last(n, ignorenulls=True).over(upto(up)).alias(f"own_{n}") for n in names])
    near = near.select("*", F.last("limit", ignorenulls=True).over(upto(down)).alias("own_next")).where("asks")
    # One row a bucket: what the buckets before and after have to offer.
    ends = marks.groupBy("bucket").agg(*[F.max(n).alias(n) for n in names], F.min("limit").alias("next"))
    every = values.sparkSession.range(buckets + 1).select(F.col("id").cast("int").alias("bucket")).join(F.broadcast(ends), "bucket", "left")
    over = Window.orderBy("bucket")
    last = [F.last(n, ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias(f"far_{n}") for n in names]
    ends = every.select("bucket", *last, F.first("next", ignorenulls=True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("far_next"))
    near = near.join(F.broadcast(ends), "bucket").select("value", *[F.coalesce(f"own_{n}", f"far_{n}").alias(n) for n in (*names, "next")])
    value, limit, cover = F.col("value"), lambda n: F.col(f"{n}.limit"), F.col("cover")
    fits = [F.when(limit(n) <= value * ABOVE, F.col(n)) for n in ("limit", "next")] + [F.when(value <= limit("top") * BEYOND, F.col("top")), F.when(cover["value"] == value, cover["at"]).otherwise(cover["after"])]
    found = F.array_min(F.transform(F.array_compact(F.array(*fits)), lambda b: F.struct(F.abs(b["limit"] - F.col("value")).alias("diff"), b["pos"], b["bracket_id"])))
    best = near.select(value.alias("at"), found.alias("best")).select("at", "best.bracket_id", "best.diff")
    return targets.join(best, F.col("value").cast("double") == F.col("at"), "left").drop("at")


def division(constraints: DataFrame, candidates: DataFrame, numbers: list[str], words: list[str], buckets: int = 64) -> DataFrame:
    """(set_id, n, first_id): for each set of constraints, how many candidates break none of them, and the smallest id.

    constraints: (set_id, name, operator, value) with <=, >= on `numbers` and = on `words` (in any case). candidates: (candidate_id and the attributes). A
    missing attribute breaks nothing, nor does a constraint of another name. Sets without constraints aren't there to be answered.

    A set becomes a box: the strictest bound of each number, the one value of each word (two different ones only suit candidates without that word). Equal boxes, and candidates of equal attributes, are one row.
    A box meets candidates by its first word if it has one, else by the buckets of the first number that it spans.
    """
    value, number = F.lower("value"), F.col("value").try_cast("double")
    parts = []
    for n in numbers:
        parts += [F.max(F.when((F.col("name") == n) & (F.col("operator") == ">="), number)).alias(f"low_{n}"), F.min(F.when((F.col("name") == n) & (F.col("operator") == "<="), number)).alias(f"high_{n}")]
    for w in words:
        own = F.when((F.col("name") == w) & (F.col("operator") == "="), value)
        parts += [F.min(own).alias(f"one_{w}"), F.max(own).alias(f"other_{w}")]
    sets = constraints.groupBy("set_id").agg(*parts)
    box = [c for c in sets.columns if c != "set_id"]
    name_of = F.to_json(F.struct(*box))  # hashes of columns pass over nulls; names don't
    boxes = sets.select(*box).distinct().withColumn("box", name_of)
    lowered = [F.lower(w).alias(w) for w in words]
    kinds = candidates.select("candidate_id", *[F.col(n).cast("double").alias(n) for n in numbers], *lowered).groupBy(*numbers, *words).agg(F.count("*").alias("n"), F.min("candidate_id").alias("first_id"))
    first = numbers[0]
    bounds = _bounds(kinds.select(F.col(first).alias("value")).where("value IS NOT NULL"), buckets)
    missing = F.lit("?")
    by_number = F.concat(F.lit("#"), F.when(F.col(first).isNull(), missing).otherwise(_bucket(bounds, F.col(first)).cast("string")))
    by_word = F.concat(F.lit("="), F.coalesce(F.col(words[0]), missing)) if words else F.lit(None).cast("string")
    keyed = kinds.select("*", F.explode(F.array_compact(F.array(by_number, by_word))).alias("key"))
    low, high = (_bucket(bounds, F.coalesce(F.col(c), F.lit(end))) for c, end in ((f"low_{first}", float("-inf")), (f"high_{first}", float("inf"))))
    spans = F.transform(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>")), lambda b: F.concat(F.lit("#"), b.cast("string")))
    spans = F.array_append(spans, F.concat(F.lit("#"), missing))
    keys = F.when(F.col(f"one_{words[0]}").isNotNull(), F.array(F.concat(F.lit("="), F.col(f"one_{words[0]}")), F.concat(F.lit("="), missing))).otherwise(spans) if words else spans
    fits = F.lit(True)
    for n in numbers:
        fits = fits & F.coalesce(F.col(n) >= F.col(f"low_{n}"), F.lit(True)) & F.coalesce(F.col(n) <= F.col(f"high_{n}"), F.lit(True))
    for w in words:
        fits = fits & F.coalesce((F.col(w) == F.col(f"one_{w}")) & (F.col(w) == F.col(f"other_{w}")), F.lit(True))
    found = boxes.select("*", F.explode(keys).alias("key")).join(keyed, "key").where(fits).groupBy("box").agg(F.sum("n").alias("n"), F.min("first_id").alias("first_id"))
    return sets.select("set_id", name_of.alias("box")).join(found, "box", "left").select("set_id", F.coalesce("n", F.lit(0)).alias("n"), "first_id")
