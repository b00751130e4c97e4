"""Runs: maximal stretches of words that repeat with a smallest period, by the runs theorem.

Method. The longest Lyndon word that starts at a place ends at the next smaller value of the inverse suffix array; under
the reversed order of letters it ends at the next larger one. Every run holds such a word, of the length of its period, under
one of the two orders (each text ends in a letter of its own, smallest in one order, largest in the other). So all runs
come from two candidates a place: a candidate that goes on for two more periods is extended to the right by the common prefix of
itself and what stands a period later, to the left by a search over such prefixes; prefixes are range minima of the LCP array.
Candidates of one run end at the same word, so the first of each (end, period) stands for them. All this is numpy over
the texts of a chunk at once, about 1 MB, or one text if that is longer; nothing is shuffled.

Words are `[^\\x20\\x09-\\x0D]+`, compared exactly. A run counts if it is `least` words and `times` periods long or more.

Defined results. Null or empty text: no words, no runs, digests of the empty string. Rows are judged each on its own, whatever their
doc_id, and keep it. Two runs may overlap, or one lie within another of a longer period; each counts. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._arrow import Words, chunks
from ._suffix import RangeMin, next_smaller, suffix_array

WORD = r"[^\x20\x09-\x0D]+"
OUT = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start: long, length: long, period: long>>, kept_text string"


def damaged(docs: DataFrame) -> DataFrame:
    """docs in which one of ten (by crc32 of doc_id) repeats from a word on: a known source of runs. Without doc_id or words: as they are."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def written(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        rest = F.transform(F.sequence(a, n - 1), lambda i: F.get(w, (a + (i - a) % p).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, F.lit(1), a.cast("int")), rest), " "))

    words = F.array(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0)))
    again = F.get(F.transform(words, written), F.lit(0))  # bound by the lambda, so words are cut once
    return docs.select("doc_id", F.when(h % 10 == 0, F.coalesce(again, "text")).otherwise(F.col("text")).alias("text"))


def _letters(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A letter for each word and one for each row's end, rising with the rows; and first and end places of each row."""
    size = words.stop - words.start
    inside = np.zeros(len(words.data) + 1, np.int8)
    inside[words.start] += 1
    inside[words.stop] -= 1
    packed = words.data[np.cumsum(inside[:-1], dtype=np.int8) > 0] if len(words) else words.data[:0]
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
    code = column.dictionary_encode().indices.to_numpy().astype(np.int64)
    kinds = int(code.max()) + 2 if len(code) else 2
    first = words.first + np.arange(words.rows)
    end = first + words.count
    letters = np.empty(len(words) + words.rows, np.int64)
    letters[end] = np.arange(words.rows) * kinds
    letters[np.arange(len(words)) + words.row] = words.row * kinds + code + 1
    return letters, first, end


def find_runs(letters: np.ndarray, first: np.ndarray, end: np.ndarray, least: int, times: int) -> tuple[np.ndarray, ...]:
    """Row, start, length and period of each run, in that order of rows, starts and periods; starts count from the row's first word."""
    _, rank, lcp = suffix_array(letters)
    row = np.repeat(np.arange(len(first)), end - first + 1)
    place, period = [], []
    for values in (rank, -rank):
        i = np.arange(len(letters))
        q = next_smaller(values) - i
        # The first such word of a run has times - 1 periods behind its start.
        i = i[i + (times - 1) * q <= end[row]]
        for turn in range(1, times - 1):
            i = i[letters[i] == letters[i + turn * q[i]]]
        place.append(i)
        period.append(q[i])
    i, q = np.concatenate(place), np.concatenate(period)
    minima = RangeMin(lcp) if len(i) else None

    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low, high = np.minimum(rank[a], rank[b]), np.maximum(rank[a], rank[b])
        return minima.least(low + 1, high)

    if len(i):
        stop = i + q + common(i, i + q)
        order = np.lexsort((i, q, stop))
        new = np.ones(len(order), bool)
        new[1:] = (stop[order][1:] != stop[order][:-1]) | (q[order][1:] != q[order][:-1])
        i, q, stop = i[order][new], q[order][new], stop[order][new]
        low, high = np.zeros(len(i), np.int64), np.minimum(q - 1, i - first[row[i]])
        while (open_ := np.flatnonzero(low < high)).size:  # the longest m so that the m words before i equal those before i + q
            m = (low[open_] + high[open_] + 1) // 2
            fits = common(i[open_] - m, i[open_] + q[open_] - m) >= m
            low[open_[fits]], high[open_[~fits]] = m[fits], m[~fits] - 1
        start = i - low
        whole = stop - start >= np.maximum(least, times * q)
        start, stop, q = start[whole], stop[whole], q[whole]
    else:
        start, stop = i, i
    order = np.lexsort((q, start))
    start, stop, q = start[order], stop[order], q[order]
    return row[start], start - first[row[start]], stop - start, q


def _longest(row: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Of each row's runs the one of greatest exponent, then of smallest start, then period. Quotients of words in memory are told apart exactly by doubles."""
    order = np.lexsort((period, start, -(length / period), row))
    new = np.ones(len(order), bool)
    new[1:] = row[order][1:] != row[order][:-1]
    return order[new]


def collapse(docs: DataFrame, least: int = 6, times: int = 4, with_text: bool = True) -> DataFrame:
    """Per row: doc_id, n_words, n_runs, the longest run's start, length, period and exponent in thousandths (null without a run),
    runs_sha256 of `start,length,period` lines, collapsed_sha256 of the kept words joined by one space, runs, and kept_text (null unless with_text).

    Of each run the first period stays; a word goes if any run holds it after that. times is 3 or more.
    """
    if times < 3:
        raise ValueError("times must be 3 or more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            words = Words(batch.column("text"), hashes=False)
            row, start, length, period = find_runs(*_letters(words), least, times)
            n, most = np.bincount(row, minlength=words.rows), _longest(row, start, length, period)
            best = np.full((4, words.rows), -1, np.int64)
            best[:, row[most]] = start[most], length[most], period[most], 1000 * length[most] // period[most]
            drop = words.first[row] + start + period
            depth = np.bincount(drop, minlength=len(words) + 1) - np.bincount(words.first[row] + start + length, minlength=len(words) + 1)
            gone = np.flatnonzero(np.cumsum(depth)[: len(words)] > 0)
            size = len(words.data) + 1
            inside = np.cumsum(np.bincount(words.start[gone], minlength=size) - np.bincount(words.stop[gone], minlength=size))[:-1] > 0
            left, ends = words.data[~inside].tobytes(), np.concatenate([[0], np.cumsum(~inside)])[words.offsets].tolist()
            kept = [b" ".join(left[a:b].split()) for a, b in zip(ends[:-1], ends[1:], strict=True)]  # bytes split at the same white space
            bounds = np.concatenate([[0], np.cumsum(n)]).tolist()
            lines = [f"{s},{m},{p}\n" for s, m, p in zip(start.tolist(), length.tolist(), period.tolist(), strict=True)]
            fields = [pa.array(x) for x in (start, length, period)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(words.count.astype(np.int64)),
                    pa.array(n.astype(np.int64)),
                    *(pa.array(x, mask=n == 0) for x in best),
                    pa.array([hashlib.sha256("".join(lines[a:b]).encode()).hexdigest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]),
                    pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"])),
                    pa.array(kept, pa.binary()).cast(pa.string()) if with_text else pa.nulls(len(kept), pa.string()),
                ],
                ["doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs", "kept_text"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, OUT)
