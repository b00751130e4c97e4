"""Turn repair, periodic runs and source mixing against brute force, on real rows and on odd ones."""

import itertools
import random
import re
import zlib
from collections import Counter

import common as c
import pytest

from inkveil.llm import periodic_runs, source_mix, turn_repair
from inkveil.llm import queries as numbered

TURNS = "conv_id long, turn long, role string, text string"

# ---- turn repair ----------------------------------------------------------------------------------------------------


def cheapest(roles, faults):
    """Least (cost, audit) by a table over all places and states, audits and all."""
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    states = {"": (0, "")}

    def insert(states):
        out = dict(states)
        for _ in range(4):
            for st, (cost, audit) in list(out.items()):
                then = "a" if st == "u" else "u"
                new = (cost + 5, audit + "I")
                out[then] = min(out.get(then, new), new)
        return out

    for role, fault in zip(roles, faults, strict=True):
        new = {}

        def put(st, value, new=new):
            new[st] = min(new.get(st, value), value)

        for st, (cost, audit) in insert(states).items():
            put(st, (cost + 2, audit + "D"))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 if fault else 0
            if role == "":
                put(st, (cost + more, audit + "K"))
            elif (st, role[0]) in after:
                put(after[st, role[0]], (cost + more, audit + "K"))
            put("a" if st == "u" else "u", (cost + 1 + more, audit + "R"))
        states = new
    return min(v for st, v in insert(states).items() if st in ("", "a"))


def fault_list(rows):
    out, seen = [], set()
    for role, text in rows:
        last = text.rstrip(" \t\n\v\f\r")[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))
    return out


def repair_brute(turns):
    """From (conv_id, turn, role, text) rows before damage."""
    convs = {}
    for conv, turn, role, text in turns:
        own = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        own += [(turn, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
    out = []
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        numbers = [t for t, _, _ in own if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        roles, faults = [r for _, r, _ in own], fault_list([(r, x) for _, r, x in own])
        cost, audit = cheapest(roles, faults)
        kept, rest, state = [], iter(own), ""
        for edit in audit:
            role, text = ("", "") if edit == "I" else next(rest)[1:]
            if edit == "D":
                continue
            if edit != "K":
                role = "assistant" if state == "u" else "user"
            state = role[:1] or state
            kept.append(f"{role}:{text}")
        n = Counter(faults)
        illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))
        out.append((conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, c.sha("\n".join(kept))))
    return sorted(out, key=str)


REPAIR = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def odd_turns(spark):
    rng = random.Random(5)
    rows = [(i // 9, i % 9, rng.choice(["user", "assistant", "assistant", "system", "tool", "", None]), rng.choice(["a.", "b!", "c", "", " \n", None, f"t{i}?", f"t{i}", "é 😀."])) for i in range(900)]
    rows += [(200, t, r, x) for t in (None, 3, 3, 7) for r, x in (("user", "hi."), ("assistant", "so."))] + [(None, 1, "user", "x."), (None, None, "assistant", "y.")]
    rows += [(201, 1, "user", "same.")] * 40 + [(202, t, "user" if t % 2 else "assistant", f"long {t}.") for t in range(700)] + [(203, 1, "user", "z" * 200_000)]
    return spark.createDataFrame(rows, TURNS).repartition(5)


@pytest.mark.parametrize("source", ["tables", "odd"])
@pytest.mark.parametrize("block", [turn_repair.BLOCK, 3])
def test_repair(spark, source, block, monkeypatch):
    turns = spark.read.parquet(f"{c.SF}/conversations.parquet") if source == "tables" else odd_turns(spark)
    plans = turn_repair.planned
    monkeypatch.setattr(turn_repair, "planned", lambda rows: plans(rows, block))
    got = turn_repair.digests(turn_repair.damaged(turns), turns.select("conv_id").distinct())
    assert c.rows(got, *REPAIR) == repair_brute([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in turns.collect()])


def test_search_is_least_of_all_edits():
    """Against every string of edits, for short conversations."""
    legal = re.compile("(s?(ua)+)?")
    for codes in map("".join, itertools.product("suaoUASx", repeat=2)):
        best = None
        for edits in itertools.product(["D", "K", "Ru", "Ra"], repeat=2):
            for gaps in itertools.product(["", "u", "a", "ua", "au"], repeat=3):
                roles, audit, cost = "", "", 0
                for gap, code, edit in zip(gaps, codes, edits, strict=False):
                    roles, audit, cost = roles + gap, audit + "I" * len(gap) + edit[0], cost + 5 * len(gap) + {"D": 2, "K": 0}.get(edit, 1)
                    if edit != "D":
                        cost += 99 if code == "x" else 5 if code.isupper() else 0
                        roles += code.lower() if edit == "K" else edit[1]
                roles, audit, cost = roles + gaps[2], audit + "I" * len(gaps[2]), cost + 5 * len(gaps[2])
                if legal.fullmatch(roles):
                    best = min(best or (cost, audit), (cost, audit))
        joiner = turn_repair.Joiner()
        joiner.add(turn_repair.block_paths(codes))
        assert joiner.result() == best, codes


def test_repaired_turns(spark):
    turns = spark.createDataFrame([(1, 0, "assistant", "hi."), (1, 1, "user", "Cut"), (1, 2, "user", "Why?"), (1, 3, "assistant", "So.")], TURNS)
    got = [(r["edit"], r["role"], r["text"]) for r in turn_repair.repaired(turns).orderBy("place").collect()]
    assert got == [("K", "user", "Why?"), ("K", "assistant", "So.")]


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], TURNS)
    assert turn_repair.digests(none).count() == 0
    only = turn_repair.digests(none, spark.createDataFrame([(7,)], "conv_id long")).collect()
    assert [tuple(r) for r in only] == [(7, 0, 0, 0, 0, 0, 0, 0, "", c.sha(""))]


# ---- periodic runs --------------------------------------------------------------------------------------------------


def runs_brute(w, least=6, times=4):
    out = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            if n >= max(least, times * q) and not any(all(w[i + x] == w[i + x + p] for x in range(n - p)) for p in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed_brute(doc_id, text):
    w = c.WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = runs_brute(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    s, n, q = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{a},{b},{d}\n" for a, b, d in runs)
    return (doc_id, len(runs), s, n, q, 1000 * n // q if runs else None, c.sha(lines), c.sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


RUNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


@pytest.mark.parametrize("source", ["tables", "odd", "empty"])
def test_runs(spark, source):
    docs = spark.read.parquet(f"{c.SF}/documents.parquet") if source == "tables" else c.odd_documents(spark) if source == "odd" else c.empty_documents(spark)
    got = c.rows(periodic_runs.collapse(periodic_runs.damaged(docs)), *RUNS)
    assert got == sorted((collapsed_brute(i, text) for i, text in c.pairs(docs)), key=str)


def test_runs_of_small_alphabets():
    import pyarrow as pa

    from inkveil.llm._arrow import Words

    rng, texts = random.Random(1), ["", " ", "a " * 700]
    for _ in range(600):
        letters, parts = "abcdefgh"[: rng.choice([1, 2, 2, 3, 5])], []
        for _ in range(rng.randrange(6)):
            unit = [rng.choice(letters) for _ in range(rng.randrange(1, 9))]
            parts += (unit * rng.randrange(1, 9))[: rng.randrange(1, 60)] + [rng.choice(letters) for _ in range(rng.randrange(4))]
        texts.append(" ".join(parts))
    got = [[] for _ in texts]
    for row, *run in zip(*(x.tolist() for x in periodic_runs.find_runs(*periodic_runs._letters(Words(pa.array(texts), hashes=False)), 6, 4)), strict=True):
        got[row].append(tuple(run))
    assert got == [runs_brute(t.split()) for t in texts]


def test_kept_words_and_runs(spark):
    docs = spark.createDataFrame([(1, "x  a b\na b a b a b a y", "c")], "doc_id long, text string, runs string")
    row = periodic_runs.collapse(docs).first()
    assert (row["kept_text"], [tuple(r) for r in row["runs"]]) == ("x a b y", [(1, 9, 2)])


def test_runs_of_a_long_text(spark):
    text = " ".join(f"w{i % 50_000}" for i in range(300_000))
    row = periodic_runs.collapse(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row["n_runs"], row["start"], row["length"], row["period"], len(row["kept_text"].split())) == (1, 0, 300_000, 50_000, 50_000)


def test_suffix_array():
    import numpy as np

    from inkveil.llm._suffix import RangeMin, next_smaller, suffix_array

    rng = random.Random(2)
    for _ in range(60):
        letters = [rng.randrange(1, 4) for _ in range(rng.randrange(60))] + [0]
        order, rank, lcp = suffix_array(np.array(letters))
        want = sorted(range(len(letters)), key=lambda i: letters[i:])
        assert order.tolist() == want and all(rank[i] == k for k, i in enumerate(want))
        common = [next((k for k, (x, y) in enumerate(zip(letters[a:], letters[b:], strict=False)) if x != y), 0) for a, b in zip(want, want[1:], strict=False)]
        assert lcp.tolist()[1:] == common
        values = np.array([rng.randrange(50) for _ in range(rng.randrange(1, 400))])
        low = np.array([rng.randrange(len(values)) for _ in range(50)])
        high = np.array([rng.randrange(a, len(values)) for a in low.tolist()])
        assert RangeMin(values).least(low, high).tolist() == [values[a : b + 1].min() for a, b in zip(low.tolist(), high.tolist(), strict=True)]
        smaller = [next((j for j in range(i + 1, len(values)) if values[j] < values[i]), len(values)) for i in range(len(values))]
        assert next_smaller(values).tolist() == smaller == next_smaller(values, near=1).tolist()


# ---- source mixing --------------------------------------------------------------------------------------------------


def targets_brute(sizes, weights=(5, 2, 1), most=3):
    """By resharing the excess until no target is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed = {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = sum(sizes.values()) - sum(fixed.values())
        shares = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if shares[s] > most * sizes[s]]
        if not above:
            return fixed | shares
        fixed |= {s: most * sizes[s] for s in above}


def mix_checked(rows, sizes):
    """rows: (source, size, source_size, target, taken)."""
    want, taken = targets_brute(sizes), Counter()
    for source, size, own, target, took in rows:
        assert own == sizes[source] and target == pytest.approx(want[source]) and 0 <= took <= 3 * size
        taken[source] += took
    for source, target in want.items():
        assert abs(taken[source] - target) <= 0.5


@pytest.mark.parametrize("source", ["tables", "odd", "empty"])
@pytest.mark.parametrize("max_broadcast", [1 << 16, 0])
def test_mix(spark, source, max_broadcast):
    docs = spark.read.parquet(f"{c.SF}/documents.parquet") if source == "tables" else c.odd_documents(spark) if source == "odd" else c.empty_documents(spark)
    if source == "odd":  # many sources, one without words, one null, and copies without key
        docs = docs.selectExpr("doc_id", "text", "CASE doc_id % 4 WHEN 0 THEN 'é' WHEN 1 THEN 'Z' WHEN 2 THEN 'a' END AS source", "1 AS size", "2 AS key")
        docs = docs.unionByName(spark.createDataFrame([(50, "", "empty"), (51, None, "empty")] + [(None, "same words here", "copies")] * 30, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "2 AS key"))
    got = source_mix.mix(docs, keep=("source",), max_broadcast=max_broadcast).collect()
    sizes = Counter()
    for r in docs.collect():
        sizes[r["source"]] += len(c.WORD.findall(r["text"] or ""))
    assert len(got) == docs.count()
    mix_checked([(r["source"], r["size"], r["source_size"], r["target"], r["taken"]) for r in got], dict(sizes))


def test_mix_is_the_same_again_and_dealt_otherwise(spark):
    docs = spark.read.parquet(f"{c.SF}/documents.parquet")
    first = c.rows(source_mix.mix(docs), "doc_id", "taken", "copies", "cut")
    assert first == c.rows(source_mix.mix(docs.repartition(7, "text")), "doc_id", "taken", "copies", "cut")


def test_mix_gives_texts(spark):
    docs = spark.createDataFrame([(1, "a b c d", "x"), (2, "e f", "x"), (3, "g " * 100, "y")], "doc_id long, text string, source string")
    mixed = source_mix.mix(docs, weights=(1, 9), keep=("text",))
    taken = {r["doc_id"]: r["taken"] for r in mixed.collect()}
    words = Counter()
    for r in source_mix.drawn(mixed).collect():
        words[r["doc_id"]] += len(r["text"].split())
    assert dict(words) == {k: v for k, v in taken.items() if v}


def test_new_queries_cover_their_tables(spark):
    for name, key, table in (("op11_turn_repair", "conv_id", "conversations"), ("op12_periodic_runs", "doc_id", "documents"), ("op13_source_mix", "doc_id", "documents")):
        ids = {r[0] for r in spark.read.parquet(f"{c.SF}/{table}.parquet").select(key).distinct().collect()}
        assert {r[0] for r in numbered.QUERIES[name](spark, c.SF).select(key).collect()} == ids
