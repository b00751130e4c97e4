"""Web pages as rows: metadata and links by expressions, text nodes by a table function over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SKIPPED = {"script", "style", "noscript", "iframe", "object", "embed", "svg", "canvas", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


def metadata(pages: DataFrame) -> DataFrame:
    """page_id, host, protocol, language; never the whole URL."""
    return pages.select(
        "page_id",
        F.regexp_extract("url", r"^[a-zA-Z]+://([^/:?#]+)", 1).alias("host"),
        F.lower(F.regexp_extract("url", r"^([a-zA-Z]+)://", 1)).alias("protocol"),
        F.regexp_extract("html", r'<html[^>]* lang="([^"]+)"', 1).alias("language"),
    )


def links(pages: DataFrame) -> DataFrame:
    """page_id, element_id (el_1 and so on in order), href."""
    found = F.regexp_extract_all("html", F.lit(r'<a [^>]*href="([^"]*)"'), F.lit(1))
    return pages.select("page_id", F.posexplode(found).alias("at", "href")).select("page_id", F.concat(F.lit("el_"), (F.col("at") + 1).cast("string")).alias("element_id"), "href")


def endpoint_class(url: F.Column) -> F.Column:
    """What may be called: HTTPS anywhere, HTTP on this machine only."""
    host, protocol = F.regexp_extract(url, r"^[a-zA-Z]+://([^/:?#]+)", 1), F.lower(F.regexp_extract(url, r"^([a-zA-Z]+):", 1))
    return F.when(protocol == "https", "ALLOWED").when((protocol == "http") & host.isin("localhost", "127.0.0.1"), "ALLOWED_LOCAL").when(protocol == "http", "DENIED_INSECURE").otherwise("DENIED_PROTOCOL")


class _Nodes(HTMLParser):
    def __init__(self, most: int):
        super().__init__(convert_charrefs=True)
        self.most, self.rows, self.path, self.seen, self.hidden = most, [], [], [{}], [False]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        n = self.seen[-1][tag] = self.seen[-1].get(tag, 0) + 1
        own = dict(attrs)
        hidden = self.hidden[-1] or tag in SKIPPED or own.get("aria-hidden") == "true" or "hidden" in own
        place = "/".join([*self.path, f"{tag}:nth-of-type({n})"])
        if not hidden:
            if tag in ("input", "textarea") and own.get("value") and own.get("type") != "hidden":
                self._row(place, own["value"] or "", tag)
            if own.get("aria-label"):
                self._row(place, own["aria-label"] or "", "aria")
        if tag not in VOID:
            self.path.append(f"{tag}:nth-of-type({n})")
            self.seen.append({})
            self.hidden.append(hidden)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.path) - 1, -1, -1):
            if self.path[i].split(":")[0] == tag:
                del self.path[i:], self.seen[i + 1 :], self.hidden[i + 1 :]
                return

    def handle_data(self, data: str) -> None:
        if not self.hidden[-1] and data.strip():
            self._row("/".join(self.path), " ".join(data.split()), "text")

    def _row(self, path: str, text: str, source: str) -> None:
        if len(self.rows) < self.most:
            self.rows.append((len(self.rows), path, text, source))


def text_nodes(pages: DataFrame, most: int = 1000) -> DataFrame:
    """page_id, pos, element_path, text, source of visible text, field values and labels; at most `most` a page, as the model has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page, html in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist(), strict=True):
                parser = _Nodes(most)
                parser.feed(html or "")
                out += [(page, *r) for r in parser.rows]
            if out:
                types = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], ["page_id", "pos", "element_path", "text", "source"])

    return pages.select("page_id", "html").mapInArrow(run, "page_id long, pos int, element_path string, text string, source string")
