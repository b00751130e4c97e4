"""Boxes on a page: fragments stitched to lines, items of several sources fused, areas to cover."""

from __future__ import annotations

import functools
import itertools
import operator
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..config import BASE_CONFIDENCE, EVIDENCE_BOOST, LEAST_CONFIDENCE, MOST_CONFIDENCE, NEAR_PX, OTHER_BASE, OTHER_BOOST, OVERLAP_SHARE

LINE_PX, GAP_PX = 8, 25
OUT_ROWS = 10_000  # in a batch, about


def _groups(rows: DataFrame, by: list[str], order: str, run: Callable[[list[dict]], list[tuple]], schema: str) -> DataFrame:
    """run(rows) for each group, its rows in order. Groups come one after the other in sorted partitions: no group has a frame or a call of its own."""
    names = rows.columns
    targets = [c.split()[0] for c in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False).tolist() if pa.types.is_floating(c.type) else c.to_pylist() for c in batch.columns]  # no number: NaN
            yield from zip(*columns, strict=True)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = operator.itemgetter(*[names.index(c) for c in by])
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [()] * len(targets)
            return pa.RecordBatch.from_arrays([pa.array(list(c), t, from_pandas=True) for c, t in zip(columns, types, strict=True)], targets)

        for _, own in itertools.groupby(read(batches), key):
            out += run([dict(zip(names, r, strict=True)) for r in own])
            if len(out) >= OUT_ROWS:
                yield batch()
                out = []
        yield batch()

    types = [{"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}[f.dataType.simpleString()] for f in StructType.fromDDL(schema)]
    rest = [c for c in names if c not in (*by, order)]  # equal places in a fixed order
    return rows.repartition(*by).sortWithinPartitions(*by, F.col(order).asc_nulls_last(), *rest).mapInArrow(walk, schema)


def stitch(blocks: DataFrame, page: str) -> DataFrame:
    """Blocks (page, pos, text, x, y, width, height, confidence) joined to lines. The order by lines is no total order, so a page is one group."""
    names = blocks.columns

    def order(a: dict, b: dict) -> int:
        d = a["y"] - b["y"]
        return (d > 0) - (d < 0) if abs(d) > LINE_PX else (a["x"] > b["x"]) - (a["x"] < b["x"])

    def run(items: list[dict]) -> list[tuple]:
        items.sort(key=functools.cmp_to_key(order))
        out: list[dict] = []
        for b in items:
            last = out[-1] if out else None
            if last and abs(b["y"] - last["y"]) <= LINE_PX and b["x"] - (last["x"] + last["width"]) <= GAP_PX:
                tight = re.search(r"[A-Za-z0-9]$", last["text"]) and re.match(r"[@._-]", b["text"])
                last.update(
                    text=last["text"] + ("" if tight else " ") + b["text"], width=b["x"] + b["width"] - last["x"],
                    height=max(last["height"], b["height"]), confidence=min(last["confidence"], b["confidence"]),
                )
            else:
                out.append(b)
        return [tuple(i if n == "pos" else o[n] for n in names) for i, o in enumerate(out)]

    return _groups(blocks.where("text IS NOT NULL"), [page], "pos", run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.schema))


def fused_category(c: Column) -> Column:
    """Fusion's own five rules: names, addresses and accounts keep what they are called."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return (
        F.when(low.contains("email"), "email").when(low.contains("phone"), "phone").when(low.contains("payment") | low.contains("card"), "payment_card").when(low.contains("password"), "password_field")
        .when(low.contains("otp"), "otp").otherwise(low)
    )


FUSED = "page_id long, no int, category string, source string, confidence double, x double, y double, width double, height double, members int"


def fuse(items: DataFrame) -> DataFrame:
    """Items (page_id, pos, category, source, evidence array<string>, x, y, width, height): each seed takes what overlaps it, in order.

    Not transitive, so it is sequential within a page and category, which is the group.
    """

    def close(a: dict, b: dict) -> bool:
        across = max(0, min(a["x"] + a["width"], b["x"] + b["width"]) - max(a["x"], b["x"]))
        down = max(0, min(a["y"] + a["height"], b["y"] + b["height"]) - max(a["y"], b["y"]))
        least = min(a["width"] * a["height"], b["width"] * b["height"])
        near = all(abs(a[p] + a[s] / 2 - b[p] - b[s] / 2) <= NEAR_PX for p, s in (("x", "width"), ("y", "height")))
        return (least > 0 and across * down >= OVERLAP_SHARE * least) or near

    def run(rest: list[dict]) -> list[tuple]:
        out: list[tuple] = []
        while rest:
            seed = rest[0]
            own = [seed, *(r for r in rest[1:] if close(seed, r))]
            rest = [r for r in rest[1:] if not close(seed, r)]
            evidence = {e for r in own for e in r["evidence"] or ()} - {"PATTERN"}
            score = BASE_CONFIDENCE.get(seed["category"], OTHER_BASE) + sum(EVIDENCE_BOOST.get(e, OTHER_BOOST) for e in sorted(evidence))
            x, y = min(r["x"] for r in own), min(r["y"] for r in own)
            far = max(r["x"] + r["width"] for r in own) - x, max(r["y"] + r["height"] for r in own) - y
            source = "fusion" if len({r["source"] for r in own}) > 1 else seed["source"]
            score = int(min(MOST_CONFIDENCE, max(LEAST_CONFIDENCE, score)) * 100 + 0.5) / 100
            out.append((seed["page_id"], len(out), seed["category"], source, score, x, y, *far, len(own)))
        return out

    return _groups(items.withColumn("kind", fused_category(F.col("category"))), ["page_id", "kind"], "pos", run, FUSED)


def cover(b: Column, padding: float = 2.0) -> Column:
    """The area to paint over a box: padded, not beyond the top left corner."""
    x, y = F.greatest(F.lit(0.0), b["x"] - padding), F.greatest(F.lit(0.0), b["y"] - padding)
    return F.struct(x.alias("x"), y.alias("y"), (b["width"] + 2 * padding).alias("width"), (b["height"] + 2 * padding).alias("height"))


def distinct_values(found: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """One row per category and normalised value: phones by their digits, others by trimmed lower case."""
    d = F.regexp_replace("value", r"\D", "")
    normal = F.when((F.col("category") == "phone") & (F.length(d) >= 6), d).otherwise(F.lower(F.trim("value")))
    n = F.row_number().over(Window.partitionBy(*by, "category", "normal").orderBy(*order))
    return found.withColumn("normal", normal).withColumn("n", n).where("n = 1").drop("n")
