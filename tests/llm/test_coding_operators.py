"""Byte-level BPE, packing, media, chat formatting, fixity: exact against the libraries, round trips and SQL."""

import base64
import collections
import zlib

import common as c
import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from inkveil.llm import byte_bpe, chat_format, jpeg_media, packing, queries, sql, warc_fixity


@pytest.fixture(params=["tables", "odd", "empty"])
def docs(request, spark):
    if request.param == "tables":
        return spark.read.parquet(f"{c.SF}/documents.parquet")
    return c.odd_documents(spark) if request.param == "odd" else c.empty_documents(spark)


@pytest.fixture(scope="module")
def reference():
    with open(queries.RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_digests(docs, reference):
    got = c.rows(byte_bpe.digests(docs, queries.RANKS, P.PATTERN), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    want = [(i, len(ids := reference.encode_ordinary(x or "")), c.sha(",".join(map(str, ids))), c.sha(x or "")) for i, x in c.pairs(docs)]
    assert got == sorted(want, key=str)


def test_bpe_offsets_and_decoding(spark, reference):
    texts = ["naïve 😀😀 日本語 text", "a  b\n\nc ", "", "<|endoftext|> x", "한국어 ที่ שלום"]
    coded = byte_bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), queries.RANKS, P.PATTERN)
    for r in byte_bpe.decode(coded, queries.RANKS, P.PATTERN).collect():
        assert r["ids"] == reference.encode_ordinary(r["text"]) and r["decoded_text"] == r["text"]
        for i, a, b in zip(r["ids"], r["starts"], r["stops"], strict=True):
            assert reference.decode_single_token_bytes(i) in r["text"][a:b].encode()


def test_packing(docs):
    coder = Tokenizer.from_file(queries.WORD_BPE)
    coder.encode_special_tokens = True
    got = collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packing.pack(docs, queries.WORD_BPE).collect())
    want = collections.Counter()
    for i, x in c.pairs(docs):
        ids = np.array([*coder.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        for p, at in enumerate(range(0, len(ids), 2048)):
            cut = ids[at : at + 2048]
            want[i, p, at, len(cut), zlib.crc32(cut.tobytes())] += 1
    assert got == want


def test_packing_places_and_tree_rounds(spark):
    docs = spark.read.parquet(f"{c.SF}/documents.parquet").repartition(16)
    rows = packing.pack(docs, queries.WORD_BPE, group_bins=4, ids=True).collect()
    bins = collections.defaultdict(list)
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"]
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= 1.1 * sum(r["length"] for r in rows) / 2048 + 2


def test_best_fit_fills():
    bins, at, fill = packing.best_fit(np.array([5, 5, 3, 7, 10, 2, 8]), 10)
    assert fill.tolist() == [10, 10, 10, 10] and len(set(zip(bins.tolist(), at.tolist(), strict=True))) == 7


def test_media_round_trip(docs):
    out = jpeg_media.read_media(jpeg_media.write_media(docs), keep=True)
    texts = collections.Counter((i, x or "") for i, x in c.pairs(docs))
    got = collections.Counter()
    for r in out.collect():
        payload = bytes(r["thumbnail"])
        assert r["payload_bytes"] == len(payload) and len(payload) % 64 == 0 and payload and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert set(payload[r["n_bytes"] :]) <= {0} and len(payload) - r["n_bytes"] <= 64 and r["payload_sha256"] == c.sha(payload)
        got[r["doc_id"], payload[: r["n_bytes"]].decode()] += 1
    assert got == texts


def test_media_of_many_images():
    payload = np.random.default_rng(0).integers(0, 256, 64 * 8200, dtype=np.uint8)
    (media,) = jpeg_media.write_images(payload, np.array([8200]))
    images = jpeg_media.parse(media)
    assert len(images) == 2
    assert b"".join(x.tobytes() for x in jpeg_media.thumbnails(images)) == payload.tobytes()
    assert jpeg_media.parse(b"no image") == [] == jpeg_media.parse(None)


def test_colour_image_with_coefficients():
    """A hand-made interleaved image: 4:2:0, AC coefficients, no restart markers."""
    bits, dc, ac = "", jpeg_media._codes({0: 2, 3: 2, 6: 3}), jpeg_media._codes({0: 2, 0x11: 2, 0xF0: 3})
    code = lambda t, s: format(t[s][0], f"0{t[s][1]}b")
    want = []
    level = 0
    for mcu in range(2):
        for block in range(6):
            diff = (40 if block == 0 else 5) if block < 4 else 0
            size = diff.bit_length()
            bits += code(dc, size) + (format(diff, f"0{size}b") if size else "")
            bits += (code(ac, 0x11) + "1" if block == 1 else "") + (code(ac, 0xF0) + code(ac, 0x11) + "0" if block == 2 else "") + code(ac, 0)
            if block < 4:
                level += diff
                want.append(level)
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    table = jpeg_media._table
    head = b"\xff\xd8\xff\xdb\x00\x43\x00" + bytes([8] + [1] * 63) + b"\xff\xc0\x00\x11\x08" + bytes([0, 16, 0, 32, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    head += table(0, {0: 2, 3: 2, 6: 3}) + table(0x10, {0: 2, 0x11: 2, 0xF0: 3}) + b"\xff\xda\x00\x0c\x03\x01\x00\x02\x00\x03\x00\x00\x3f\x00"
    (image,) = jpeg_media.parse(head + scan + b"\xff\xd9")
    (small,) = jpeg_media.thumbnails([image])
    v = [min(255, x + 128) for x in want]
    assert small.tolist() == [[v[0], v[1], v[4], v[5]], [v[2], v[3], v[6], v[7]]]


def test_chat_folds_deltas_edits_and_regenerations(spark):
    log = [
        (1, 1, 1, "start", "user", ""), (1, 2, 1, "delta", "", "hel"), (1, 3, 1, "delta", "", "lo"),
        (1, 4, 2, "start", "assistant", ""), (1, 5, 2, "delta", "", "draft"), (1, 6, 3, "start", "user", ""), (1, 7, 3, "delta", "", "gone"),
        (1, 8, 2, "regenerate", "", ""), (1, 9, 2, "delta", "", "fi"), (1, 10, 2, "delta", "", "nal"),
        (1, 11, 4, "start", "user", ""), (1, 12, 4, "delta", "", "x"), (1, 13, 4, "edit", "", "edited"), (1, 14, 5, "start", "assistant", ""), (1, 15, 5, "delete", "", ""),
    ]
    folded = chat_format.fold(spark.createDataFrame(log, "conv_id long, seq long, message long, kind string, role string, payload string").repartition(4))
    assert c.rows(folded, "message", "role", "text") == [(1, "user", "hello"), (2, "assistant", "final"), (4, "user", "edited")]


def test_chat_round_trip_of_control_strings(spark):
    texts = ["<|im_end|>", "<\\|x", "<\\\\|im_start|>", "<", "|", "<|<||", "", None, "tail<", "é😀" * 300]
    turns = spark.createDataFrame([(1, i, "assistant" if i % 2 else "user", t, "x") for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string, seq string")
    rendered = chat_format.format_chats(turns)
    (row,) = chat_format.read_back(rendered).collect()
    assert [t["text"] for t in row["turns"]] == [t or "" for t in texts]
    assert row["loss_text"] == "".join(t or "" for t in texts[1::2])


@pytest.mark.parametrize("name", ["op5_chat_format", "op8_line_dedup", "op10_warc_fixity"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{c.SF}/{t}.parquet'")
    result = con.execute(sql.__dict__[name.split("_")[0].upper()])
    columns = sorted(x[0] for x in result.description)
    place = [[x[0] for x in result.description].index(n) for n in columns]
    want = sorted((tuple(r[i] for i in place) for r in result.fetchall()), key=str)
    df = queries.QUERIES[name](spark, c.SF)
    assert sorted(df.columns) == columns and c.rows(df, *columns) == want


def test_fixity_finds_all_kinds_and_nothing_else(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}</p>", "x") for i in range(700)] + [(None, None, None, "x"), (5, "http://h/5", "<p>5</p>", "x")], "page_id long, url string, html string, hash string")
    a = warc_fixity.records(pages)
    assert warc_fixity.audit(a, a, per_file=64).where("status <> 'intact'").count() == 0
    bad = pages.selectExpr("page_id", "url", "CASE WHEN page_id = 130 THEN '<q>130</p>' WHEN page_id = 320 THEN '<p>320</p' ELSE html END AS html").where("page_id IS NULL OR page_id <> 699")
    got = warc_fixity.audit(a, warc_fixity.records(bad), per_file=64).where("status <> 'intact'")
    found = collections.defaultdict(list)
    for r in got.collect():
        found[r["status"]].append(r["page_id"])
    assert sorted(found["corrupt"]) == [130, 320] and found["missing"] == [699] and sorted(found["moved"]) == list(range(321, 384))
    none = warc_fixity.records(pages.limit(0))
    assert warc_fixity.audit(none, none).count() == 0


def test_another_operator_leaves_no_coder_in_the_worker():
    from inkveil.llm import _arrow, toxicity

    first = packing.coder(queries.WORD_BPE)
    assert packing.coder(queries.WORD_BPE) is first  # kept from task to task of its own operator
    none = type("Sent", (), {"value": ({}, None)})
    assert not list(toxicity._ids(iter([]), none)) and not _arrow._HELD
    assert packing.coder(queries.WORD_BPE) is not first
