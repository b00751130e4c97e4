"""Byte-level BPE over Arrow batches with the tokenizers library, and exact decoding.

Method. The rank file becomes a tokenizers BPE model: every byte maps to a printable character, every rank's token to a
string of those, and every split of a token into two ranked tokens to a merge in rank order, so the library merges the
same pair that lowest-rank merging picks. A piece that is a token itself is taken whole. A text is encoded in parts
that start before a space after a visible character: there the pattern always starts a new match, so a part's ids do
not depend on its neighbours, and distinct parts are encoded once while the worker keeps them. Texts in which a space stands beside
other white space are encoded whole. Decoding reverses the byte table over all ids of a text and only then reads UTF-8,
so characters split over tokens come back whole.

Defined results. Null or empty text: no ids, empty decoded bytes. A lone id sequence that is no valid UTF-8 decodes to
its bytes; `decode` gives text with U+FFFD in place of what is broken. Ids outside the table are an error. Repeated rows
and extra columns pass through; columns that this operator adds replace others of the same name.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from hashlib import sha256
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ._arrow import chunks
from ._parts import PART_CHUNK, PartIds, rows, taken

#: White space of any kind; more of it than the pattern's \s has does no harm.
_WHITE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_BESIDE_SPACE = _WHITE + r" |\A "
_BLANK = re.compile("[\\s\u180e\u200b\ufeff]")


def byte_table() -> list[str]:
    """The character that stands for each byte: itself if printable Latin-1, else the next one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class ByteBpe:
    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks, table = read_ranks(path), byte_table()
        text = {t: "".join(table[b] for b in t) for t in ranks}
        merges = []
        for t in sorted(ranks, key=ranks.get):
            splits = [(ranks[t[:i]], ranks[t[i:]], t[:i], t[i:]) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
            merges += [(text[a], text[b]) for _, _, a, b in sorted(splits)]
        vocab = {text[t]: r for t, r in ranks.items()}
        self.tokenizer = Tokenizer(models.BPE(vocab=vocab, merges=merges, ignore_merges=True, cache_capacity=0))  # the parts are the cache
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        back = {c: b for b, c in enumerate(table)}
        bytes_of: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, r in self.tokenizer.get_vocab().items():
            bytes_of[r] = bytes(back[c] for c in token)
        self.bytes_of = pa.array(bytes_of, pa.binary())
        self.sizes = np.array([len(x) for x in bytes_of], np.int64)
        self.numerals = pa.array([b"%d," % i for i in range(len(bytes_of))], pa.binary())
        self.parts = PartIds(self._after_spaces)
        self.heads = PartIds(self._whole)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _after_spaces(self, parts: list[str], together: int = 512) -> list[bytes]:
        """Ids of each part with a space before it. Those that end visibly are encoded in a row, and told apart by their lengths in bytes."""
        out: list = [None] * len(parts)
        solid = [i for i, p in enumerate(parts) if p and not _BLANK.match(p[-1])]
        groups = [solid[k : k + together] for k in range(0, len(solid), together)]
        texts = [" " + " ".join([parts[i] for i in g]) for g in groups]
        for g, e in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            reach = np.cumsum(self.sizes[ids])
            ends = np.searchsorted(reach, np.cumsum([len(parts[i].encode()) + 1 for i in g])) + 1
            raw, start = ids.tobytes(), 0
            for i, stop in zip(g, (4 * ends).tolist(), strict=True):
                out[i], start = raw[start:stop], stop
        left = [i for i, v in enumerate(out) if v is None]
        for i, v in zip(left, self._whole([" " + parts[i] for i in left]), strict=True):
            out[i] = v
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin and end."""
        texts = texts.fill_null("")
        beside = pc.match_substring_regex(texts, _BESIDE_SPACE)
        if not beside.true_count:
            return rows(texts, self.parts, self.heads)
        ids, bounds = rows(pc.if_else(beside, "", texts), self.parts, self.heads)
        raw, pieces = ids.tobytes(), []
        whole = dict(zip(np.flatnonzero(beside.to_numpy(zero_copy_only=False)).tolist(), self._whole(texts.filter(beside).to_pylist()), strict=True))
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            pieces.append(whole[i] if i in whole else raw[4 * a : 4 * b])
        return np.frombuffer(b"".join(pieces), "<u4"), np.concatenate([[0], np.cumsum([len(p) // 4 for p in pieces], dtype=np.int64)])

    def numbers(self, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """Decimal numerals, a comma after each."""
        return taken(self.numerals, ids)

    def decoded(self, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """The bytes of each id, by the byte table."""
        return taken(self.bytes_of, ids)

    def decode(self, ids: list[int]) -> bytes:
        return bytes(self.decoded(np.array(ids, "<u4"))[0])

    def offsets(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and stop of each token of one text, in code points; a token of part of a character has that character."""
        raw, at = self.decoded(ids)
        data = np.frombuffer(raw, np.uint8)
        leads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        start, stop = at[:-1], at[1:]
        inner = np.zeros(len(start), bool)
        inner[start < len(data)] = (data[start[start < len(data)]] & 0xC0) == 0x80
        return leads[start] - inner, leads[stop]


_CODERS: dict[tuple[str, str], ByteBpe] = {}


def coder(path: str, pattern: str) -> ByteBpe:
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = ByteBpe(path, pattern)
    return _CODERS[path, pattern]


def _with(docs: DataFrame, added: str, fill) -> DataFrame:
    """docs and the added columns; `fill` gives their arrays for a slice of rows."""
    names = [c.split()[0] for c in added.split(", ")]
    kept = docs.drop(*names)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + [added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=PART_CHUNK):
            yield pa.RecordBatch.from_arrays([*batch.columns, *fill(batch)], [*batch.schema.names, *names])

    return kept.mapInArrow(run, schema)


def encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Adds ids, and each token's start and stop in the text."""

    def fill(batch: pa.RecordBatch) -> list[pa.Array]:
        bpe = coder(ranks, pattern)
        ids, bounds = bpe.encode(batch.column("text"))
        spans = [bpe.offsets(ids[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
        return [lists, *(pa.array([s[k] for s in spans], pa.list_(pa.int64())) for k in (0, 1))]

    return _with(docs, "ids array<int>, starts array<long>, stops array<long>", fill)


def decode(coded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Adds decoded_bytes and decoded_text of the column ids (null: no ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks, pattern)
        for batch in batches:
            raw = [bpe.decode(i or []) for i in batch.column("ids").to_pylist()]
            added = [pa.array(raw, pa.binary()), pa.array([r.decode("utf-8", "replace") for r in raw], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "decoded_bytes", "decoded_text"])

    kept = coded.drop("decoded_bytes", "decoded_text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, schema + ", decoded_bytes binary, decoded_text string")


def digests(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks, pattern)
        for batch in chunks(batches, limit=PART_CHUNK):
            ids, bounds = bpe.encode(batch.column("text"))
            (numbers, n), (decoded, d) = bpe.numbers(ids), bpe.decoded(ids)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(np.diff(bounds)),
                    pa.array([sha256(numbers[a : max(b - 1, a)]).hexdigest() for a, b in pairwise(n[bounds].tolist())]),
                    pa.array([sha256(decoded[a:b]).hexdigest() for a, b in pairwise(d[bounds].tolist())]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
