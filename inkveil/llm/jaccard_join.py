"""Exact set-similarity self-join on word shingles, as components, with adaptive multi-match prefixes.

Method. A document's tokens (hashes of its distinct shingles) stand in one global order: tokens known to be frequent last, by
frequency, the others by hash. If two sets of sizes n <= m reach the threshold t, they share a token that is among the first
n - ceil(2tn / (1 + t)) + 1 of the smaller and the first m - ceil(tm) + 1 of the larger: posting lists hold these plain prefixes and
say which entries are so early, and only such pairs are candidates. Before a candidate is verified it must pass a multi-match
test: every document's prefix is lengthened to n - ceil(tn) + l tokens, with l by its candidates' cost as estimated from the
frequencies of its plain prefix (the dearer, the longer), and the two must share correspondingly more tokens of it: their least
overlap, less the most that can lie beyond the prefix that ends first. Frequencies come from all documents: each chunk of
rows reports the tokens it holds twice or more, Spark sums them, and the `hot_tokens` heaviest (a fixed number, so a
bounded broadcast) form the order. The order affects only cost, never the result.

Copies and near copies. Of equal sets, the smallest document alone sends postings (beyond `max_copies` further copies: the
smallest of each chunk). A posting list first pairs each document with
the list's smallest document only; verified pairs are joined into components. While lists have many more pairs across
components than entries, and it helps, their documents are paired with a few pivots drawn by hash in further rounds. Then the lists
that still hold several components give all candidates across components, so a large group
of near copies costs its size and no link between components is lost. Pairs are verified on the full sets of 64-bit shingle hashes.

Defined results. Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased; fewer words than a shingle: the whole
sequence is one; no words or null text: empty set, linked with nothing. doc_id identifies a document; repeated rows of
one doc_id come out as often as they go in. Rows without doc_id have component null. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._arrow import Words, chunks, mix, release
from ._components import components
from ._shared import stash

_U = np.uint64
MOST_MATCHES = 8


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each distinct shingle, sorted by row, then hash."""
    words = Words(column, fold=True)
    whole = np.flatnonzero(words.whole(k))
    row, h = words.row[whole], words.windows(k)[whole] if len(whole) else np.zeros(0, np.uint64)
    short = np.flatnonzero((words.count > 0) & (words.count < k))
    if len(short):
        first = words.first[short]
        row = np.concatenate([row, short])
        h = np.concatenate([h, words.spans(first, first + words.count[short])])
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


def _signatures(row: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size of each row's set and two order-free 64-bit sums over it."""
    n = np.bincount(row, minlength=rows)
    ends = np.concatenate([[0], np.cumsum(n)])
    out = []
    for seed in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ _U(seed)), dtype=np.uint64)])
        out.append(total[ends[1:]] - total[ends[:-1]])
    return n, out[0], out[1]


def _firsts(n: np.ndarray, s1: np.ndarray, s2: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Rows that are the smallest document of their set in this chunk, empty sets left out."""
    order = np.lexsort((doc, s2, s1, n))
    a = np.stack([n[order].astype(np.uint64), s1[order], s2[order]])
    new = np.ones(len(order), bool)
    new[1:] = (a[:, 1:] != a[:, :-1]).any(axis=0)
    return np.sort(order[new & (n[order] > 0)])


SUMMARY = "doc_id long, n long, s1 long, s2 long, shard int, cells binary"
FREQUENT = "doc_id long, n long, s1 long, s2 long, cell long, times long"
CELL_BITS, HELD_TOKENS = 24, 2 << 20


def cells(h: np.ndarray, shards: int) -> np.ndarray:
    """The counter of each token: shard, then place in it. Tokens that share one are counted together, so a count is never too small."""
    return ((h >> _U(32)) % _U(shards)) << _U(CELL_BITS) | (h & _U((1 << CELL_BITS) - 1))


def _gaps(place: np.ndarray) -> bytes:
    """Sorted places as the gaps between them, two bytes each or three; the first byte says which."""
    gap = np.diff(place, prepend=0).astype("<u4")
    size = 2 if gap.max() < 1 << 16 else 3
    return bytes([size]) + gap.view(np.uint8).reshape(-1, 4)[:, :size].tobytes()


def _places(raw: memoryview) -> np.ndarray:
    size = raw[0]
    gap = np.zeros(((len(raw) - 1) // size, 4), np.uint8)
    gap[:, :size] = np.frombuffer(raw[1:], np.uint8).reshape(-1, size)
    return np.cumsum(gap.view("<u4")[:, 0], dtype=np.uint32)


def _shard_rows(tokens: list[np.ndarray], shards: int) -> pa.RecordBatch:
    at = np.sort(cells(np.concatenate(tokens), shards))
    shard = (at >> _U(CELL_BITS)).astype(np.int64)
    edge = np.searchsorted(shard, np.arange(shards + 1))
    own = np.flatnonzero(np.diff(edge))
    place = (at & _U((1 << CELL_BITS) - 1)).astype(np.int64)
    packed = [_gaps(place[a:b]) for a, b in zip(edge[own].tolist(), edge[own + 1].tolist(), strict=True)]
    none = pa.nulls(len(own), pa.int64())
    return pa.RecordBatch.from_arrays([none, none, none, none, pa.array(own.astype(np.int32)), pa.array(packed, pa.binary())], [x.split()[0] for x in SUMMARY.split(", ")])


def summaries(docs: DataFrame, k: int, shards: int, least: int) -> DataFrame:
    """A row (doc_id, n, s1, s2) of each document, and a row (cell, times) of each counter that `least` sets or more meet in.

    Every token of every set is counted, but for sets that their chunk of rows has already: a task sends the sorted counters of
    about 2 million tokens at a time, two or three bytes a token, and those of one shard are merged by one task.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, held = [], 0
        for batch in chunks(batches):
            row, h = shingle_sets(batch.column("text"), k)
            n, s1, s2 = _signatures(row, h, batch.num_rows)
            size = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary())],
                [x.split()[0] for x in SUMMARY.split(", ")],
            )
            one = np.zeros(size, bool)
            one[_firsts(n, s1, s2, np.arange(size))] = True
            tokens.append(h[one[row]])
            held += len(tokens[-1])
            if held >= HELD_TOKENS:
                yield _shard_rows(tokens, shards)
                tokens, held = [], 0
        if held:
            yield _shard_rows(tokens, shards)
        release()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, met = [x.split()[0] for x in FREQUENT.split(", ")], {}
        for batch in batches:
            ours = batch.column("shard").is_valid()
            rows = batch.filter(pc.invert(ours))
            none = pa.nulls(rows.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("doc_id", "n", "s1", "s2")), none, none], names)
            counted = batch.filter(ours)
            for shard, raw in zip(counted.column("shard").to_pylist(), counted.column("cells"), strict=True):
                met.setdefault(shard, []).append(_places(memoryview(raw.as_buffer())))
        for shard, places in met.items():
            place = np.sort(np.concatenate(places))
            edge = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1], [True]]))
            times = np.diff(edge)
            often = np.flatnonzero(times >= least)
            none = pa.nulls(len(often), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(place[edge[often]].astype(np.int64) | shard << CELL_BITS), pa.array(times[often].astype(np.int64))], names)
        release()

    return docs.mapInArrow(count, SUMMARY).repartition(F.coalesce(F.col("shard").cast("long"), F.xxhash64("doc_id"))).mapInArrow(merge, FREQUENT)


def matches_needed(n: np.ndarray, cost: np.ndarray, least: np.ndarray) -> np.ndarray:
    """l of each document: 1 for the cheapest, one more for each doubling of its estimated candidates, as far as its set allows."""
    wanted = 1 + np.ceil(np.log2(1 + cost / np.maximum(n, 1))).astype(np.int64)
    return np.clip(wanted, 1, np.minimum(least, MOST_MATCHES))


class Order(NamedTuple):
    """The counters of frequent tokens, sorted, with their counts, and the number of shards."""

    tokens: np.ndarray
    weights: np.ndarray
    shards: int


def ordered(row: np.ndarray, h: np.ndarray, rows: int, percent: int, order: Order) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of each row in global order, each one's place in its row, and each row's size, least overlap and l."""
    at = cells(h, order.shards)
    maybe = np.zeros(1 << 22, bool)
    low = _U((1 << 22) - 1)
    maybe[(order.tokens & low).astype(np.int64)] = True
    weight = np.zeros(len(h), np.int64)
    look = np.flatnonzero(maybe[(at & low).astype(np.int64)])
    if len(look):
        found = np.minimum(np.searchsorted(order.tokens, at[look]), len(order.tokens) - 1)
        weight[look] = np.where(order.tokens[found] == at[look], order.weights[found], 0)
    by = np.argsort(row.astype(np.int64) * (1 << 40) + np.minimum(weight, (1 << 40) - 1), kind="stable")
    h, weight = h[by], weight[by]
    n = np.bincount(row, minlength=rows)
    least = -(-percent * n // 100)
    place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
    plain = place < (n - least + 1)[row]
    cost = np.bincount(row[plain], weights=weight[plain], minlength=rows)
    return h, place, n, least, matches_needed(n, cost, least)


POSTINGS = "token long, doc_id long, n int, early boolean"


def postings(docs: DataFrame, k: int, percent: int, sent: Broadcast) -> DataFrame:
    """The plain prefix of each document that is the first of its set in its chunk; early: within what equal or larger sets must meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            ids = batch.column("doc_id")
            batch = batch.filter(ids.is_valid()) if ids.null_count else batch
            if not batch.num_rows:
                continue
            doc = batch.column("doc_id").to_numpy().astype(np.int64)
            row, h = shingle_sets(batch.column("text"), k)
            keep = np.zeros(batch.num_rows, bool)
            keep[_firsts(*_signatures(row, h, batch.num_rows), doc)] = True
            row, h = row[keep[row]], h[keep[row]]
            h, place, n, least, _ = ordered(row, h, batch.num_rows, percent, sent.value)
            early = n - -(-2 * percent * n // (100 + percent)) + 1
            take = np.flatnonzero(place < (n - least + 1)[row])
            at = row[take]
            for c in range(0, len(take), 100_000):
                s = slice(c, c + 100_000)
                columns = (h[take[s]].view(np.int64), doc[at[s]], n[at[s]].astype(np.int32), place[take[s]] < early[at[s]])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], [x.split()[0] for x in POSTINGS.split(", ")])

    return docs.mapInArrow(run, POSTINGS)


def _candidate(percent: int) -> Column:
    """Whether the sizes allow a link, and the shared token is early in the smaller set (in both, if equal)."""
    sizes = (F.col("a_n") * 100 >= F.col("b_n") * percent) & (F.col("b_n") * 100 >= F.col("a_n") * percent)
    return sizes & (F.col("a_early") | (F.col("a_n") > F.col("b_n"))) & (F.col("b_early") | (F.col("b_n") > F.col("a_n")))


def _few(df: DataFrame, most: int) -> bool:
    return df.limit(most + 1).count() <= most


def _asked(docs: DataFrame, pairs: DataFrame, max_broadcast_ids: int = 1 << 20) -> DataFrame:
    """The documents of the pairs (a, b). Up to max_broadcast_ids, their ids go to the scan and no text is moved; beyond, both sides are shuffled."""
    ids = stash(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "ids")
    return docs.join(F.broadcast(ids) if _few(ids, max_broadcast_ids) else ids, "doc_id", "left_semi")


def _packed(docs: DataFrame, k: int, percent: int, sent: Broadcast, prefix: bool) -> DataFrame:
    """(doc_id, n, l, tokens): the whole set of each document, or its lengthened prefix; sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            row, h = shingle_sets(batch.column("text"), k)
            n, l = np.bincount(row, minlength=batch.num_rows), np.zeros(batch.num_rows, np.int64)
            if prefix:
                h, place, n, least, l = ordered(row, h, batch.num_rows, percent, sent.value)
                take = place < (n - least + l)[row]
                row, h = row[take], h[take]
                by = np.lexsort((h, row))
                row, h = row[by], h[by]
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))]).tolist()
            raw = h.tobytes()
            packed = [raw[8 * a : 8 * b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(l), pa.array(packed, pa.binary())], ["doc_id", "n", "l", "tokens"])

    return docs.mapInArrow(run, "doc_id long, n long, l long, tokens binary")


def _tested(pairs: DataFrame, packed: DataFrame, percent: int, prefix: bool) -> DataFrame:
    """The pairs whose prefixes share what a link needs, or whose sets reach the threshold. A row of tokens is sent once for each pair it is the `a` of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            sizes = zip(*(batch.column(c).to_pylist() for c in ("a_n", "b_n", "a_l", "b_l")), strict=True)
            for x, y, (n, m, i, j) in zip(batch.column("x"), batch.column("y"), sizes, strict=True):
                both = np.sort(np.concatenate([np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)]), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                if prefix:
                    # What both share up to where the first prefix ends is in both; ceil(t n) - l tokens lie beyond it.
                    beyond = max(-(-percent * n // 100) - i, -(-percent * m // 100) - j)
                    good.append(shared >= -(-percent * (n + m) // (100 + percent)) - beyond)
                else:
                    good.append(100 * shared >= percent * (n + m - shared))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    x = packed.select(F.col("doc_id").alias("a"), F.col("tokens").alias("x"), F.col("n").alias("a_n"), F.col("l").alias("a_l"))
    y = packed.select(F.col("doc_id").alias("b"), F.col("tokens").alias("y"), F.col("n").alias("b_n"), F.col("l").alias("b_l"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y", "a_n", "b_n", "a_l", "b_l").mapInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int, sent: Broadcast) -> DataFrame:
    """Of the candidates (a, b), those that reach the threshold: the multi-match test first, then the whole sets."""
    for prefix in (True, False):
        pairs = stash(pairs.select("a", "b").distinct(), "pairs")
        if pairs.isEmpty():
            break
        packed = stash(_packed(_asked(docs, pairs), k, percent, sent, prefix), "prefixes" if prefix else "sets")
        pairs = _tested(pairs, packed, percent, prefix)
    return stash(pairs, "links")


def _mixed(lists: DataFrame, label: DataFrame) -> DataFrame:
    """The posting lists (token, doc_id, n, early) that hold several components, with each document's."""
    by_token = Window.partitionBy("token")
    named = lists.select("token", "doc_id", "n", "early").join(label.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    several = (F.min("component").over(by_token) != F.max("component").over(by_token)) & F.bool_or("early").over(by_token)
    return named.repartition("token").withColumn("several", several).where("several").drop("several")


def _crossing(mixed: DataFrame) -> tuple[int, float]:
    """Entries of the lists, and at most how many candidates across components they give: pairs of which one entry at least is early."""

    def squares(name: str) -> list[Column]:
        return [F.sum(name).alias(name), F.sum(F.col(name) * F.col(name)).alias(f"{name}2")]

    parts = mixed.groupBy("token", "component").agg(F.count("*").alias("all"), F.count_if(~F.col("early")).alias("late"))
    lists = parts.groupBy("token").agg(*squares("all"), *squares("late"))
    pairs = (F.col("all") * F.col("all") - F.col("all2") - F.col("late") * F.col("late") + F.col("late2")) / 2
    found = lists.agg(F.coalesce(F.sum("all"), F.lit(0)), F.coalesce(F.sum(pairs), F.lit(0.0))).first()
    return found[0], found[1]


def _sides(rows: DataFrame, other: str) -> DataFrame:
    """Candidates (a, b) of rows with columns doc_id, n, early and a struct of the same."""
    own = [F.col(c).alias(f"a_{c}") for c in ("n", "early")] + [F.col(f"{other}.{c}").alias(f"b_{c}") for c in ("n", "early")]
    return rows.select(F.col("doc_id").alias("a"), F.col(f"{other}.doc_id").alias("b"), *own)


def _pivot_pairs(mixed: DataFrame, turn: int, percent: int, pivots: int = 4) -> DataFrame:
    """Each document with a list's pivot if that is of another component. Pivots are drawn by a hash, the same for a quarter of all tokens."""
    draw = F.xxhash64("doc_id", F.pmod("token", F.lit(pivots)), F.lit(turn))
    pivot = F.min(F.struct(draw.alias("draw"), "doc_id", "n", "early", "component")).over(Window.partitionBy("token"))
    met = mixed.repartition("token").withColumn("pivot", pivot).where("component <> pivot.component")
    return _sides(met, "pivot").where(_candidate(percent)).select("a", "b")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 75, hot_tokens: int = 1 << 19, max_copies: int = 1 << 20, crossing_share: float = 64.0) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shards = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    summary = stash(summaries(docs, k, shards, 4), "summary")
    hot = summary.where("cell IS NOT NULL").select("cell", "times").orderBy(F.desc("times"), "cell").limit(hot_tokens).orderBy("cell").toArrow()
    # Equal sets are one class, linked to its smallest document.
    rows = summary.where("n IS NOT NULL").select("doc_id", "n", "s1", "s2")
    heads = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("head"), F.count("*").alias("copies")).where("copies > 1")
    heads = stash(heads, "heads")
    few = _few(heads, max_copies // 4)  # a set that a third of all documents have is no hot key then
    copies = rows.join(F.broadcast(heads) if few else heads, ["n", "s1", "s2"]).where("doc_id <> head").select(F.col("doc_id").alias("a"), F.col("head").alias("b"))
    copies = stash(copies.distinct(), "copies")
    single = docs.join(F.broadcast(copies.select(F.col("a").alias("doc_id"))), "doc_id", "left_anti") if _few(copies, max_copies) else docs
    order = Order(hot["cell"].to_numpy().view(np.uint64), hot["times"].to_numpy(), shards)
    sent = docs.sparkSession.sparkContext.broadcast(order)

    by_token = Window.partitionBy("token")
    entry = F.struct("doc_id", "n", "early")
    counted = postings(single, k, percent, sent).repartition("token").select("*", F.count("*").over(by_token).alias("docs"), F.min(entry).over(by_token).alias("pivot"))
    lists = stash(counted.where("docs > 1"), "postings")
    star = _sides(lists.where("doc_id <> pivot.doc_id"), "pivot").where(_candidate(percent))
    links, mixed, turn = verified(star, docs, k, percent, sent), lists, 0
    while True:
        mixed = stash(_mixed(mixed, components(links)), "mixed")
        entries, crossing = _crossing(mixed)
        if crossing <= crossing_share * entries:
            break
        turn += 1
        more = verified(_pivot_pairs(mixed, turn, percent), docs, k, percent, sent)
        if more.limit(turn + 1).count() <= turn:  # few or none: the lists hold texts that only resemble each other
            links = links.unionByName(more)
            break
        links = stash(links.unionByName(more), "links")

    # The smaller of two sets has the shared token early (equal ones both), so late entries never meet each other.
    left, right = (mixed.select("token", *[F.col(c).alias(f"{s}_{c}") for c in ("n", "early", "component")], F.col("doc_id").alias(s)) for s in "ab")
    smaller = (F.col("a_n") < F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & F.col("b_early") & (F.col("a") < F.col("b")))
    across = left.where("a_early").join(right, "token").where(smaller & (F.col("a_n") * 100 >= F.col("b_n") * percent) & (F.col("a_component") != F.col("b_component")))
    rest = verified(across, docs, k, percent, sent)
    sent.destroy()

    found = components(links.unionByName(rest).unionByName(copies))
    out = rows.join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
