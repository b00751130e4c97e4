"""Toxicity by held-out accuracy, nearest neighbours by recall, the pipeline against its stages' brute force."""

import collections
import itertools
import zlib

import common as c
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from inkveil.llm import ann_tree, queries, toxicity


def planted(spark, n=600):
    import random

    rng = random.Random(2)
    bad = ["idiot", "worthless", "scumbag", "1d10t", "w0rthless", "i d i o t", "idiooot", "s.c.u.m.b.a.g"]
    plain = ["house", "garden", "river", "summer", "bread", "window", "story", "letter", "market", "street"]
    rows = []
    for i in range(n):
        w = [rng.choice(plain) for _ in range(rng.randrange(5, 60))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad[:3] if i % 10 else bad[3:]))
        rows.append((i, " ".join(w), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxicity_held_out(spark):
    rows = planted(spark)
    out = toxicity.toxicity(rows.select("doc_id", "text"), rows.select("doc_id", "toxic")).join(rows.select("doc_id", "toxic"), "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert len(held) > 60 and np.mean([r["predicted"] == r["toxic"] for r in held]) > 0.97


def test_decoding():
    cost = np.full((toxicity.SYMBOLS,) * 3, 5.0)
    word = [0, 0, *(toxicity._number(x) for x in "idiot"), 0]
    for a, b, x in zip(word, word[1:], word[2:], strict=False):
        cost[a, b, x] = 0.5
    for text in ("1d10t", "id!ot", "idiooot", "i.d.i.o.t", "i d i o t", "1-d-1-0-t"):
        assert toxicity.restored(text, cost) == ("idiot", True)
    assert toxicity.restored("hello,", cost) == ("hello", False)


def likely(*words):
    cost = np.full((toxicity.SYMBOLS,) * 3, 5.0)
    for own in words:
        word = [0, 0, *(toxicity._number(x) for x in own), 0]
        for a, b, x in zip(word, word[1:], word[2:], strict=False):
            cost[a, b, x] = 0.5
    return cost


def test_short_restored_words_keep_their_features():
    cost = likely("ass")
    for text in ("a55", "a.s.s", "a s s", "@ss"):
        assert set(toxicity.features(*toxicity.restored(text, cost))) >= set(toxicity.features("ass", False)) == {"=ass"}
    for word in ("i", "as", "ass", "dumb", "idiot"):
        assert set(toxicity.features(word, True)) >= set(toxicity.features(word, False))
    assert "=ass" in toxicity.features("dumbass", True)


def test_doubled_letters_are_decoded():
    cost = likely("idiot", "hello")
    for text in ("iiddiioott", "iddiot", "idiott", "(iddiot)"):
        assert toxicity.restored(text, cost) == ("idiot", True)
    for text in ("hello", "committee", "she'll", "don't", "word,word"):
        assert toxicity.restored(text, likely("hello", "committee", "shell")) == (text, False)
    assert {"=idiot", "=iddiot"} <= toxicity.token_features("iddiot", cost)


@pytest.mark.parametrize("text", ["(i d i o t)", '"i d i o t"', "'i.d.i.o.t'", "“i d i o t”", "you(i d i o t)", "_i d i o t_", "i  d  i  o  t", "i, d, i, o, t", "i,d,i,o,t", "i~d~i~o~t", "i|d|i|o|t", "i - d -- i\to\nt"])
def test_spaced_stretches(text):
    cost = likely("idiot")
    assert "=idiot" in {f for t in toxicity.tokens(f"well {text} then") for f in toxicity.token_features(t, cost)}


def test_stretches_begin_and_end_with_their_words():
    assert toxicity.tokens("i don't a b c defg") == {"i", "don't", "a", "b", "c", "defg", "a b c"}
    assert {"a s s", "a s s, b c"} <= toxicity.tokens("a s s, b c")


def test_toxicity_of_odd_rows(spark):
    docs = c.odd_documents(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["predicted"] for r in toxicity.toxicity(docs, none).collect()} == {0}
    some = spark.createDataFrame([(1, 0), (1, 0), (4, 1), (None, 1), (5, None), (9, 1), (10, 0), (11, 1)], "doc_id long, toxic int")
    out = toxicity.toxicity(docs, some).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.toxicity(c.empty_documents(spark), none).count() == 0


@pytest.fixture
def vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 8)) + 5 * rng.integers(0, 3, size=(1500, 1))
    x[300:800] = x[300]
    rows = [(i, v.astype(np.float32).tolist(), "c") for i, v in enumerate(x)]
    rows += [(2000, None, "c"), (2100, [0.0] * 8, "c"), (2200, [float("nan")] * 8, "c"), (2300, [None] + [1.0] * 7, "c"), (2400, [float("inf")] * 8, "c"), (None, [1.0] * 8, "c"), rows[7]]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, leaf string").repartition(3)


def test_nearest_neighbours(spark, vectors):
    valid = {}
    for r in vectors.collect():
        e = r["embedding"]
        if r["vec_id"] is not None and e is not None and None not in e and np.isfinite(e).all() and np.any(e):
            valid[r["vec_id"]] = np.array(e, float)
    ids = np.array(sorted(valid))
    x = np.stack([valid[i] for i in ids])
    searcher = ann_tree.Searcher(vectors, leaf_rows=32, block=64)
    got = {}
    for r in searcher.search(vectors.where("vec_id % 100 = 0")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = []
    for q in ids[ids % 100 == 0]:
        far = np.sqrt(((x - valid[q]) ** 2).sum(1))
        far[ids == q] = np.inf
        best = ids[np.lexsort((ids, far))[:10]]
        own = sorted(got.pop(q))
        assert [r for r, _, _ in own] == list(range(1, 11)) and [(s, v) for _, v, s in own] == sorted((s, v) for _, v, s in own)
        assert all(abs(np.sqrt(((valid[v] - valid[q]) ** 2).sum()) - s) < 1e-12 for _, v, s in own)
        hits.append(len(set(best) & {v for _, v, _ in own}) / 10)
    assert not got and np.mean(hits) >= 0.9


def test_outliers_have_k_neighbours(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(1200, 4)), 1000 * rng.normal(size=(60, 4))])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    searcher = ann_tree.Searcher(table, leaf_rows=32, recall=0.5, probes=4)
    found = collections.Counter(r["query_id"] for r in searcher.search(table).collect())
    assert searcher.visits < searcher.tree.leaves and found == dict.fromkeys(range(len(x)), 10)


def test_the_most_frequent_length_is_valid(spark):
    rows = [(i, [float(i), 1.0] if i % 3 else [1.0] * (3 + i)) for i in range(30)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for first in (0, 3, 6, 9):  # some malformed row is the first by hash
        some = table.where(F.col("vec_id").isin([first, first + 1, first + 2]))
        assert ann_tree.Searcher(some).width == 2
    assert {r["query_id"] for r in ann_tree.Searcher(table).search(table).collect()} == {i for i in range(30) if i % 3}


def test_few_or_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0]), (100, [1.0, 2.0]), (5, [3.0, 4.0])], "vec_id long, embedding array<double>")
    assert c.rows(ann_tree.Searcher(few).search(few.where("vec_id % 100 = 0")), "query_id", "rank", "vec_id") == [(0, 1, 100), (0, 2, 5), (100, 1, 0), (100, 2, 5)]
    none = few.limit(0)
    assert ann_tree.Searcher(none).search(none).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{c.SF}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, c.SF)
    labels = spark.read.parquet(f"{c.SF}/labels.parquet")
    rejected = {r["doc_id"] for r in toxicity.toxicity(docs, labels).collect() if r["predicted"]}
    assert {r["doc_id"] for r in clean.collect()} == set(before) - rejected
    lined = stages["line dedup"](spark, docs, c.SF)
    assert lined.columns == docs.columns
    assert {(r["doc_id"], c.sha(r["text"])) for r in lined.collect()} == {(i, h) for i, _, _, h in c.lines_brute(c.pairs(docs))}
    single = stages["near copies"](spark, docs, c.SF)
    assert {r["doc_id"] for r in single.collect()} == {i for i, _, head in c.groups_brute(c.pairs(docs)) if head == i}
    cut = stages["substring dedup"](spark, docs, c.SF)
    assert {(r["doc_id"], c.sha(" ".join(c.WORD.findall(r["text"])))) for r in cut.collect()} == {(i, h) for i, _, _, h in c.spans_brute(c.pairs(docs))}
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect())
    assert {r["doc_id"] for r in stages["best-fit packing"](spark, cut, c.SF).collect()} == set(before)


def test_run_against_brute_force(spark):
    """Toxicity's decisions are its own; what the other stages make of what is left is worked out in plain Python."""
    docs = spark.read.parquet(f"{c.SF}/documents.parquet")
    rejected = {r["doc_id"] for r in toxicity.toxicity(docs, spark.read.parquet(f"{c.SF}/labels.parquet")).collect() if r["predicted"]}
    texts = {i: x or "" for i, x in c.pairs(docs) if i not in rejected}
    key = lambda line: c.low(line.strip(" \t\n\v\f\r"))
    holders = collections.defaultdict(set)
    for i, x in texts.items():
        for line in x.split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(i)
    texts = {i: "\n".join(line for line in x.split("\n") if len(holders.get(key(line), ())) < 5 or max(holders[key(line)]) == i) for i, x in texts.items()}
    heads = {i for i, _, head in c.groups_brute(list(texts.items())) if head == i}
    texts = {i: x for i, x in texts.items() if i in heads}
    seen, want = set(), collections.Counter()
    coder = Tokenizer.from_file(queries.WORD_BPE)
    coder.encode_special_tokens = True
    for i in sorted(texts):
        words, gone = c.WORD.findall(texts[i]), set()
        for a in range(len(words) - 19):
            window = tuple(words[a : a + 20])
            if window in seen:
                gone.update(range(a, a + 20))
            seen.add(window)
        ids = np.array([*coder.encode(" ".join(w for j, w in enumerate(words) if j not in gone), add_special_tokens=False).ids, 0], "<u4")
        want.update((i, k, at, len(cut := ids[at : at + 2048]), zlib.crc32(cut.tobytes())) for k, at in enumerate(range(0, len(ids), 2048)))
    got = corpus_pipeline.run(spark, c.SF).collect()
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all([o for o, _ in sorted(own)] == [0, *itertools.accumulate(n for _, n in sorted(own))][:-1] and sum(n for _, n in own) <= 2048 for own in bins.values())


def test_viterbi_against_all_readings():
    rng = np.random.default_rng(6)
    cost = rng.uniform(0.1, 6, (toxicity.SYMBOLS,) * 3)
    for token in ("1d10t", "a55", "id!ot", "iidd", "s.c.u", "x$1", "bbb0", "é3é"):
        readings = {}
        for way in itertools.product(*toxicity.lattice(token)):
            word, price = "".join(x for x, _ in way), sum(p for _, p in way)
            seq = [0, 0, *map(toxicity._number, word), 0]
            total = price + sum(float(cost[a, b, x]) for a, b, x in zip(seq, seq[1:], seq[2:], strict=False))
            readings[word] = min(total, readings.get(word, np.inf))
        best = min(readings, key=readings.get)
        word, price = toxicity.cheapest(token, cost)
        assert word == best and abs(price - readings[best]) < 1e-9


def test_scores_against_plain_python(spark):
    docs = spark.read.parquet(f"{c.SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{c.SF}/labels.parquet"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    for i, text in c.pairs(docs):
        own = {f for t in toxicity.tokens(text or "") for f in toxicity.token_features(t, model.cost)}
        z = model.bias + sum(model.weights[model.ids[f]] for f in own if f in model.ids)
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-9


def test_pipeline_of_odd_and_no_rows(spark, tmp_path):
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (c.odd_documents(spark), c.empty_documents(spark)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert docs.limit(1).count() == out.limit(1).count()
            docs = out


def test_features_of_a_long_token_are_linear(spark):
    """200,000 letters and digits: memory and time of a token's length, not of its square."""
    import random
    import resource

    rng = random.Random(3)
    token = "".join(rng.choice("abcdefgh0134") for _ in range(200_000))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    found = toxicity.token_features(token, likely("idiot"))
    assert len(found) > 100_000 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000


def test_long_features_tell_words_apart_as_spelled_ones():
    a, b = "x" * 100 + "abc", "x" * 100 + "abd"
    long_a, long_b = ({f for f in toxicity.features(w, True) if f.startswith("#")} for w in (a, b))
    assert len(long_a) == len(long_b) == 103 - toxicity.SPELLED and not long_a & long_b
    assert next(f for f in toxicity.features("q" + a, False) if f[0] == "#") not in long_a
    assert set(toxicity.features(a, True)) <= set(toxicity.features("zz" + a, True))


@pytest.mark.parametrize("label", [0, 1])
def test_labels_of_one_kind_reject_nothing(spark, label):
    """Nor does a model without features."""
    docs = spark.createDataFrame([(i, f"text number {i}", "en", "s", 13) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(1, 1, label)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 40 and {r["predicted"] for r in got} == {0}
    mostly = spark.createDataFrame([(i, 1, int(i % 5 > 0)) for i in range(40)], "doc_id long, quality int, toxic int")
    assert {r["predicted"] for r in toxicity.toxicity(docs.withColumn("text", F.lit("same words")), mostly).collect()} == {0}


def test_repeated_doc_ids_are_learned_from_once(spark):
    docs = spark.createDataFrame([(7, "b"), (7, "a"), (7, "a"), (8, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 1) for i in range(20)], "doc_id long, quality int, toxic int")
    ids = {r["doc_id"] for r in labels.where(~toxicity.held_out()).select("doc_id").collect()}
    got = sorted(r["text"] for r in toxicity.labelled(docs, labels, 100).collect())
    assert got == sorted(["a"] * (7 in ids) + ["c"] * (8 in ids))


def test_query_id_of_two_vectors_still_gets_k(spark):
    rows = [(i, [float(i), 1.0]) for i in range(40)] + [(0, [0.25, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = ann_tree.Searcher(table).search(table.where("vec_id = 0")).collect()
    assert len(found) == 20 and all(r["vec_id"] != 0 for r in found)
    assert sorted({r["vec_id"] for r in found}) == list(range(1, 11))


def test_drawn_rows_are_bounded_before_they_are_sorted(spark):
    table = spark.range(4000).selectExpr("id AS vec_id", "array(cast(id AS float), 1f) AS embedding").repartition(8)
    some = ann_tree.drawn_rows(table, 200)
    assert some.count() == 200 == some.select("vec_id").distinct().count()
    order = F.xxhash64("vec_id", "embedding")
    assert sorted(r["vec_id"] for r in some.collect()) == sorted(r["vec_id"] for r in table.orderBy(order).limit(200).collect())
    assert "Filter" in some._jdf.queryExecution().optimizedPlan().toString()  # no partition sends 200 rows of its own
    same = spark.range(4000).selectExpr("7L AS vec_id", "array(1f, 2f) AS embedding")
    assert 1 <= ann_tree.drawn_rows(same, 200).count() <= 200
    assert ann_tree.drawn_rows(table, 5000).count() == 4000


@pytest.mark.parametrize("scale", [1.0, 1e-160, 1e160])
def test_block_products_leave_the_nearest(scale):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(700, 6)), 1) * scale
    x[100:140] = x[0] + 1e-9 * scale * rng.normal(size=(40, 6))
    ids = [np.array([i, 1000 + i]) if i % 5 == 0 else np.array([i]) for i in range(len(x))]
    flat, of = np.concatenate(ids), np.repeat(np.arange(len(x)), [len(i) for i in ids])
    queries = x[:300]
    with np.errstate(over="ignore", under="ignore"):
        for q, own, far in ann_tree._partial(queries, x, ids, 12):
            true = np.sqrt(((x - queries[q]) ** 2).sum(1))[of]
            best = np.lexsort((flat, true))[:12]
            assert own.tolist() == flat[best].tolist() and far.tolist() == true[best].tolist()


def test_leaves_are_put_together_to_parcels():
    assert ann_tree.parcels(np.array([3, 3, 3, 0, 9, 1, 1]), 6).tolist() == [0, 0, 1, 1, 1, 2, 2]
