"""Line dedup, span removal, near copies: exact against brute force, on real rows and on odd ones."""

import common as c
import pytest

from inkveil.llm import jaccard_join, line_dedup, substring_dedup
from inkveil.llm._components import components


@pytest.fixture(params=["tables", "odd", "empty"])
def docs(request, spark):
    if request.param == "tables":
        return spark.read.parquet(f"{c.SF}/documents.parquet")
    return c.odd_documents(spark) if request.param == "odd" else c.empty_documents(spark)


@pytest.mark.parametrize("way", [{}, {"shard_keys": 8, "max_broadcast": 0}])
def test_lines(docs, way):
    got = c.rows(line_dedup.dedup_lines(docs, **way), "doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert got == sorted(c.lines_brute(c.pairs(docs)), key=str)


def test_perfect_hash_is_minimal():
    import numpy as np

    h = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64))
    _, slot = line_dedup.build_mph(h)
    assert sorted(slot.tolist()) == list(range(len(h)))


def test_spans(docs):
    got = c.rows(substring_dedup.remove_repeats(docs), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(c.spans_brute(c.pairs(docs)), key=str)


def test_spans_of_periodic_and_shared_texts(spark):
    import random

    rng = random.Random(3)
    shared = [" ".join(f"s{rng.randrange(50)}" for _ in range(n)) for n in (19, 20, 21, 60)]
    texts = [f"{' '.join(f'r{rng.randrange(9)}' for _ in range(rng.randrange(30)))} {rng.choice(shared)} {rng.choice(['a b ', 'x ', 'p q r ']) * rng.randrange(40)}{rng.choice(shared)}" for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = c.rows(substring_dedup.remove_repeats(docs), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(c.spans_brute(c.pairs(docs)), key=str)


def test_kept_text_keeps_unremoved_white_space(spark):
    words = " ".join(f"w{i}" for i in range(25))
    docs = spark.createDataFrame([(1, words), (2, f" head\n{words}\n\ttail ")], "doc_id long, text string")
    texts = {r["doc_id"]: r["kept_text"] for r in substring_dedup.remove_repeats(docs).collect()}
    assert texts == {1: words, 2: " head\n\ttail "}


def test_near_copies(docs):
    got = c.rows(jaccard_join.near_duplicates(docs), "doc_id", "n_shingles", "component_id")
    assert got == sorted(c.groups_brute(c.pairs(docs)), key=str)


def test_near_copies_in_chains_and_crowds(spark):
    import random

    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(1, 9)):
            w[rng.randrange(len(w))] = f"u{rng.randrange(10**6)}"
        texts.append(" ".join(w[: rng.choice([120, 110, 95])]))
    drift = [f"d{i}" for i in range(80)]
    for i in range(12):
        texts.append(" ".join(drift[i * 3 :] + [f"e{j}" for j in range(i * 3)]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = c.rows(jaccard_join.near_duplicates(docs, hot_tokens=32), "doc_id", "n_shingles", "component_id")
    assert got == sorted(c.groups_brute(c.pairs(docs)), key=str)


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r["id"]: r["component"] for r in components(links).distinct().collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_texts_beyond_a_chunk(spark):
    """Texts of more than the bytes that a worker takes at a time, near copies of each other, beside short and missing ones."""
    import zlib

    import numpy as np
    import public_tokenizers as P
    import tiktoken
    from tokenizers import Tokenizer

    from inkveil.llm import _arrow, byte_bpe, packing, queries

    long = " ".join(f"w{i * i % 7919}x{i % 101}" + ("\n" if i % 50 == 0 else "") for i in range(150_000))
    assert len(long) > _arrow.CHUNK_BYTES
    texts = [long, long + " tail", "short", None, long[: len(long) // 2]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert c.rows(substring_dedup.remove_repeats(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(c.spans_brute(c.pairs(docs)), key=str)
    assert c.rows(line_dedup.dedup_lines(docs), "doc_id", "n_lines", "n_dropped", "kept_sha256") == sorted(c.lines_brute(c.pairs(docs)), key=str)
    assert c.rows(jaccard_join.near_duplicates(docs), "doc_id", "n_shingles", "component_id") == sorted(c.groups_brute(c.pairs(docs)), key=str)
    with open(queries.RANKS, "rb") as f:
        ranks = byte_bpe.read_ranks(f.name)
    exact = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = [(i, len(ids := exact.encode_ordinary(x or "")), c.sha(",".join(map(str, ids))), c.sha(x or "")) for i, x in enumerate(texts)]
    assert c.rows(byte_bpe.digests(docs, queries.RANKS, P.PATTERN), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=str)
    coder = Tokenizer.from_file(queries.WORD_BPE)
    pieces = []
    for i, x in enumerate(texts):
        ids = np.array([*coder.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        pieces += [(i, k, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    assert c.rows(packing.pack(docs, queries.WORD_BPE), "doc_id", "piece", "length", "ids_crc32") == sorted(pieces, key=str)


def test_counts_never_fall_short(spark):
    """A counter's value is at least the number of different sets that hold its token."""
    import numpy as np
    import pyarrow as pa

    docs = spark.read.parquet(f"{c.SF}/documents.parquet").repartition(3)
    counted = {r["cell"]: r["times"] for r in jaccard_join.summaries(docs, 5, 8, 2).where("cell IS NOT NULL").collect()}
    texts = sorted({tuple(sorted(c.shingles(x))): x for _, x in c.pairs(docs) if x}.values())
    _, h = jaccard_join.shingle_sets(pa.array(texts), 5)
    cell, times = np.unique(jaccard_join.cells(h, 8), return_counts=True)
    assert all(counted.get(int(a), 0) >= n for a, n in zip(cell, times, strict=True) if n > 1)
