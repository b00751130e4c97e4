"""Toxicity scores of deobfuscated text.

Method. A noisy channel: writers replace letters by look-alikes, space words out, and repeat letters. A character trigram model
with counts from every word of every document is the language model. A token that the channel may have touched (letters
mixed with look-alikes, single characters with separators between, equal letters in a row) becomes a lattice of
readings; Viterbi search over pairs of last letters finds the cheapest one under model and channel costs, and the token is
restored to it. Other tokens stay. Features of the restored text are its words and their beginnings of 4 to 6 letters
(within a restored token, those from any letter on); a logistic regression over the most telling ones gives the score.

Learning. The model is fitted on at most `sample` labelled rows (the smallest by a hash of doc_id) that are not held out,
i.e. whose crc32(doc_id as text) mod 5 is not 0; that bound and `features` are the only ones. Labels, language, source
and doc_id are no inputs of a score. Scoring is one pass over whole texts with the fitted weights broadcast (their number is
a parameter).

Defined results. Null or empty text: the score of no features. No usable labels, or labels of one kind: every score is that kind's smoothed
share. Several labels of one doc_id: toxic if any is. Rows without doc_id are scored but never learned from, and are not
held out. Repeated rows have equal scores. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import chunks, forget, release
from ._shared import stash

#: Symbols of the language model: 0 is no letter, then a to z, then the letters U+00DF to U+00FF, then any other letter.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if chr(c).isalpha())
SYMBOLS = len(LETTERS) + 2
#: Letters that each look-alike may stand for.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "+": "t", "€": "e", "£": "l"}
SUBSTITUTED, SKIPPED, COLLAPSED, UNDOUBLED = 1.0, 0.3, 0.3, 4.0  # costs in nats
UNTOUCHED = 1.5  # nats that a reading must save where doubled letters are the only sign of the channel
CACHED_TOKENS = 300_000

# A sign is a letter, digit or look-alike. A stretch begins after white space or punctuation, not inside a word (don't, e-mail).
_SIGN, _END = r"(?:[^\W_]|[@$!+€£])", r"(?![^\W_]|[@$+€£])"
_BEGIN = r"(?<![^\W_])(?<![@$!+€£])(?<![^\W_](?:[^\w\s(\[{<\"“„«]|_))"
_SPACED = re.compile(rf"{_BEGIN}{_SIGN}(?:[ .\-_*/]{_SIGN}){{2,}}{_END}")
_WIDE = re.compile(rf"{_BEGIN}{_SIGN}(?:(?:[^\w@$!+€£]|_)+{_SIGN}){{2,}}{_END}")  # runs of any separators
_EDGES = " \t\n\"'()[]{}<>.,;:?!*_-/|#=~`“”„«»…"
_ODD = re.compile(r"(.)\1\1|[0-9@$!+€£]|[^\W\d_][ .\-_*/][^\W\d_]")
_DOUBLED = re.compile(r"([^\W\d_])\1")
_LETTER = re.compile(r"[^\W\d_]")


class Model(NamedTuple):
    cost: np.ndarray  # of the third symbol after two others, in nats
    ids: dict[str, int]
    weights: np.ndarray
    bias: float


# ---- the language model -------------------------------------------------------------------------------------------


def _symbol_table() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for i in range(0x250):
        if chr(i).isalpha():
            table[i] = SYMBOLS - 1
    table[0x250:0x3000] = [SYMBOLS - 1 if chr(i).isalpha() else 0 for i in range(0x250, 0x3000)]
    table[0x3000:] = 0
    for i, c in enumerate(LETTERS):
        table[ord(c)] = i + 1
    return table


_TABLE: list[np.ndarray] = []


def symbols(text: str) -> np.ndarray:
    if not _TABLE:
        _TABLE.append(_symbol_table())
    return _TABLE[0][np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(trigram, times) over all texts; a trigram is a number below SYMBOLS ** 3."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in chunks(batches, limit=1 << 20):
            s = symbols("  ".join(["", *batch.column("text").fill_null("").to_pylist(), ""])).astype(np.int32)
            total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["trigram", "times"])

    return docs.select("text").mapInArrow(run, "trigram int, times long").groupBy("trigram").agg(F.sum("times").alias("times"))


def language_model(docs: DataFrame) -> np.ndarray:
    """Costs of every trigram, interpolated with the bigram's and the symbol's own; the number of counts that come here is fixed."""
    counts = np.zeros(SYMBOLS**3)
    for r in trigram_counts(docs).collect():
        counts[r["trigram"]] = r["times"]
    counts = counts.reshape((SYMBOLS,) * 3)
    bi, uni = counts.sum(0), counts.sum((0, 1))
    p1 = (uni + 1) / (uni.sum() + SYMBOLS)
    p2 = (bi + 5 * p1) / (bi.sum(1, keepdims=True) + 5)
    p3 = (counts + 5 * p2[None]) / (counts.sum(2, keepdims=True) + 5)
    return -np.log(p3)


# ---- the channel --------------------------------------------------------------------------------------------------


def _number(c: str) -> int:
    i = LETTERS.find(c)
    return i + 1 if i >= 0 else SYMBOLS - 1


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """Readings of each character with their costs; the empty reading leaves it out."""
    out = []
    for stretch in re.finditer(r"(.)\1*", token, re.DOTALL):
        c, times = stretch[1], len(stretch[0])
        if c.isalpha():
            own = [(c, 0.0)]
        else:
            own = [(x, SUBSTITUTED) for x in LOOKALIKES.get(c, "")]
            if not own or c == "!":
                own.append(("", SKIPPED))
        again = own + [("", COLLAPSED if times > 2 else UNDOUBLED)]
        out += [own] + [again] * (times - 1)
    return out


def cheapest(token: str, cost: np.ndarray) -> tuple[str, float]:
    """The reading of least cost, and that cost: Viterbi over the last two letters."""
    states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    for options in lattice(token):
        after: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (paid, path) in states.items():
            for c, price in options:
                if c:
                    n = _number(c)
                    key, total, way = (b, n), paid + price + float(cost[a, b, n]), (c, path)
                else:
                    key, total, way = (a, b), paid + price, path
                if key not in after or total < after[key][0]:
                    after[key] = (total, way)
        states = after
    price, path = min((paid + float(cost[a, b, 0]), path) for (a, b), (paid, path) in states.items())
    letters = []
    while path:
        c, path = path
        letters.append(c)
    return "".join(reversed(letters)), price


def decode(token: str, cost: np.ndarray) -> str:
    return cheapest(token, cost)[0]


def plain_cost(word: str, cost: np.ndarray) -> float:
    """Of the letters as they stand, other characters left out."""
    a, b, paid = 0, 0, 0.0
    for c in word:
        if c.isalpha():
            n = _number(c)
            paid, a, b = paid + float(cost[a, b, n]), b, n
        else:
            paid += SKIPPED
    return paid + float(cost[a, b, 0])


def restored(token: str, cost: np.ndarray) -> tuple[str, bool]:
    """A lower-case token without edge punctuation, decoded if the channel may have touched it; and whether it was.

    Doubled letters alone are common, so a reading without them must save UNTOUCHED nats.
    """
    word = token.strip(_EDGES)
    if not _LETTER.search(word):
        return word, False
    if _ODD.search(word) or _WIDE.fullmatch(word):
        return decode(word, cost), True
    if m := _DOUBLED.search(word):
        if word.isalpha() and not _DOUBLED.search(word, m.end()):  # one pair: its three trigrams decide, as the search would
            i = m.start()
            b, c, d = _number(word[i - 1]) if i else 0, _number(word[i]), _number(word[i + 2]) if i + 2 < len(word) else 0
            saved = float(cost[b, c, c]) + float(cost[c, c, d]) - float(cost[b, c, d]) - UNDOUBLED
            return (word[:i] + word[i + 1 :], True) if saved > UNTOUCHED else (word, False)
        reading, price = cheapest(word, cost)
        if price + UNTOUCHED < plain_cost(word, cost):
            return reading, True
    return word, False


# ---- features -----------------------------------------------------------------------------------------------------


UNTOLD = math.log(1 / 3)  # the score's log odds where labels are of one kind or no feature tells them apart: nothing counts as toxic
CACHED_FEATURES = 1 << 19
SPELLED = 64  # features up to so many letters are spelled, longer ones go by a 61-bit rolling hash: a token costs its length, not its square
_BASE, _PRIME = 0x2545F4914F6CDD1D, (1 << 61) - 1


def features(word: str, anywhere: bool) -> Iterator[str]:
    """Beginnings of 4, 5 and 6 letters and the whole rest of the word, from its start or from anywhere in it."""
    hashed = 0
    stop = max(len(word) - 2, 1) if anywhere else 1
    for i in range(len(word) - 1, stop - 1, -1) if len(word) > SPELLED else ():
        hashed = (hashed * _BASE + ord(word[i]) + 1) % _PRIME
    for i in range(stop - 1, -1, -1):
        size = len(word) - i
        if len(word) > SPELLED:
            hashed = (hashed * _BASE + ord(word[i]) + 1) % _PRIME
        if size > SPELLED:
            yield f"#{hashed:x}"
        elif size > 2:
            yield "=" + word[i:]
        yield from ("^" + word[i : i + n] for n in (4, 5, 6) if size >= n)


def told_features(token: str, cost: np.ndarray) -> Iterator[str]:
    """Those of the restored token; where it is of letters only and may be a word as it stands, its own too. Some may come twice."""
    word, decoded = restored(token, cost)
    yield from features(word, decoded)
    own = token.strip(_EDGES) if decoded else ""
    if own.isalpha():
        yield from features(own, False)


def token_features(token: str, cost: np.ndarray) -> set[str]:
    return set(told_features(token, cost))


def tokens(text: str) -> set[str]:
    """Distinct lower-case tokens, and the spaced-out stretches, as they stand: by runs of any separators, and within those by single ones."""
    text = text.lower()
    out = set(text.split())
    for m in _WIDE.finditer(text):
        out.add(m.group())
        out.update(x.group() for x in _SPACED.finditer(text, m.start(), m.end()))
    return out


class Features(dict):
    """Numbers of the known features of each token; a worker's memory."""

    def __init__(self, ids: dict[str, int], cost: np.ndarray):
        self.ids, self.cost = ids, cost

    def __missing__(self, token: str) -> tuple[int, ...]:
        if len(self) > CACHED_TOKENS:
            self.clear()
        found = tuple({i for f in told_features(token, self.cost) if (i := self.ids.get(f)) is not None})
        self[token] = found
        return found

    def of(self, text: str) -> set[int]:
        return {i for own in map(self.__getitem__, tokens(text)) if own for i in own}


def _ids(batches: Iterator[pa.RecordBatch], sent) -> Iterator[tuple[pa.RecordBatch, list[set[int]]]]:
    forget()
    known = Features(*sent.value)
    for batch in chunks(batches):
        yield batch, [known.of(t) for t in batch.column("text").fill_null("").to_pylist()]
    known.clear()
    release()


# ---- learning -----------------------------------------------------------------------------------------------------


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(text, toxic) of at most `sample` documents that aren't held out, a row each: where rows of one doc_id differ, the least text counts."""
    one = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    drawn = one.where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    joined = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return stash(joined.select("text", "toxic"), "labelled")


def _common(rows: DataFrame, cost: np.ndarray, most: int) -> list[str]:
    """Features in 3 toxic documents or more, the most frequent `most` of them."""
    sent = rows.sparkSession.sparkContext.broadcast(cost)

    def told(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["feature", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        seen: Counter = Counter()
        for batch in chunks(batches):
            for text in batch.column("text").fill_null("").to_pylist():
                seen.update({f for t in tokens(text) for f in told_features(t, sent.value)})
                if len(seen) > CACHED_FEATURES:  # counts of a feature add up further on
                    yield told(seen)
                    seen.clear()
        yield told(seen)
        seen.clear()
        release()

    counted = rows.where("toxic = 1").mapInArrow(run, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    return [r["feature"] for r in counted.where("n >= 3").orderBy(F.desc("n"), "feature").limit(most).collect()]


def _counted(rows: DataFrame, names: list[str], cost: np.ndarray) -> np.ndarray:
    """Documents of label 0 and 1 that have each of the features."""
    sent = rows.sparkSession.sparkContext.broadcast(({f: i for i, f in enumerate(names)}, cost))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch, own in _ids(batches, sent):
            for toxic, ids in zip(batch.column("toxic").to_pylist(), own, strict=True):
                seen.update((toxic, i) for i in ids)
        yield pa.RecordBatch.from_arrays([pa.array([k[j] for k in seen], pa.int32()) for j in (0, 1)] + [pa.array(list(seen.values()), pa.int64())], ["toxic", "id", "n"])

    out = np.zeros((2, len(names)))
    for r in rows.mapInArrow(run, "toxic int, id int, n long").groupBy("toxic", "id").agg(F.sum("n").alias("n")).collect():
        out[int(r["toxic"] != 0), r["id"]] = r["n"]
    return out


def logistic(row: np.ndarray, column: np.ndarray, y: np.ndarray, width: int, l2: float = 0.3, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias for sparse 0/1 features, by accelerated gradient steps on the mean loss."""
    w, n = np.zeros(width + 1), max(len(y), 1)
    w[-1] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-(w[-1] + np.bincount(row, weights=w[column], minlength=len(y)))))
        g = np.append(np.bincount(column, weights=(p - y)[row], minlength=width) + l2 * w[:-1], (p - y).sum()) / n
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w -= 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-9)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000, features: int = 4096) -> Model:
    cost = language_model(docs)
    rows = labelled(docs, labels, sample)
    size = {int(r["toxic"]): r["count"] for r in rows.groupBy("toxic").count().collect()}
    good, bad = size.get(0, 0), size.get(1, 0)
    untold = Model(cost, {}, np.zeros(0), UNTOLD)
    if not good or not bad:
        return untold
    names = _common(rows, cost, 16 * features)
    seen = _counted(rows, names, cost)
    odds = np.log((seen[1] + 0.5) / (bad - seen[1] + 0.5)) - np.log((seen[0] + 0.5) / (good - seen[0] + 0.5))
    sure = odds / np.sqrt(1 / (seen[1] + 0.5) + 1 / (seen[0] + 0.5))
    chosen = [i for i in np.argsort(-np.abs(sure), kind="stable")[:features] if abs(sure[i]) > 3]
    ids = {names[i]: k for k, i in enumerate(chosen)}
    if not ids:
        return untold
    sent = rows.sparkSession.sparkContext.broadcast((ids, cost))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, own in _ids(batches, sent):
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([sorted(i) for i in own], pa.list_(pa.int32()))], ["toxic", "ids"])

    y, row, column = [], [], []
    for r in rows.mapInArrow(run, "toxic int, ids array<int>").toLocalIterator():
        row += [len(y)] * len(r["ids"])
        column += r["ids"]
        y.append(float(r["toxic"] != 0))
    weights, bias = logistic(np.array(row, np.int64), np.array(column, np.int64), np.array(y), len(ids))
    return Model(cost, ids, weights, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, score."""
    sent = docs.sparkSession.sparkContext.broadcast((model.ids, model.cost))
    weights, bias = model.weights.tolist(), model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, own in _ids(batches, sent):
            z = np.array([bias + sum(weights[i] for i in sorted(ids)) for ids in own])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    scored = score(docs, fit(docs, labels, sample))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
