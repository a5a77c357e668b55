"""Interleaved document sequences with media columns.

A page's HTML is parsed into an ordered array of structs (pos, kind, text, digest, caption): texts between media
elements and references of the form sha256:<digest>. Payloads are kept once each, as greymaps of 8-bit samples, in a
media table keyed by the digest of the stored bytes; references meet them there in a join by digest. Features are
read from stored bytes where these lie, so that the join carries a few numbers for each reference, not the payloads;
resolve() attaches any columns of the media table, the stored bytes too if asked for.

Defined results: null HTML or text counts as empty; a reference without a payload keeps its place with null media
columns; media that occur several times are one row of the table.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 576
ITEM = "array<struct<pos:int,kind:string,text:string,digest:string,caption:string>>"
REF = "sha256:"
BLOCKS = {"p", "div", "article", "section", "li", "h1", "h2", "h3", "h4", "h5", "h6", "br", "tr", "figure", "figcaption", "title", "footer", "nav", "ul"}
MEDIA = {"img", "video", "audio", "source"}
SILENT = {"script", "style"}


class Sequence(HTMLParser):
    """Collects the texts and media references of one page in order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.buffer: list[str] = []
        self.silent = 0
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.buffer).split())
        self.buffer = []
        if text:
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag in SILENT:
            self.silent += 1
        elif tag in MEDIA:
            self.flush()
            src = a.get("src") or ""
            self.items.append({"kind": "media", "text": None, "digest": src.removeprefix(REF) if src.startswith(REF) else None, "caption": a.get("alt")})
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in BLOCKS:
            self.flush()

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption" and self.caption is not None:
            said, self.caption = " ".join("".join(self.caption).split()), None
            last = next((x for x in reversed(self.items) if x["kind"] == "media"), None)
            if last is not None and said:
                last["caption"] = said
        elif tag in BLOCKS:
            self.flush()

    def handle_data(self, data: str) -> None:
        if self.caption is not None:
            self.caption.append(data)
        elif not self.silent:
            self.buffer.append(data)


def sequence(page: str) -> list[dict]:
    s = Sequence()
    s.feed(page)
    s.close()
    s.flush()
    return [x | {"pos": i} for i, x in enumerate(s.items)]


def interleaved(pages: DataFrame, html_col: str = "html", out: str = "items") -> DataFrame:
    """pages with an array of their texts and media references in order."""

    @F.pandas_udf(ITEM)
    def parsed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([sequence(x) if isinstance(x, str) else [] for x in b], dtype=object)

    return pages.withColumn(out, parsed(F.col(html_col)))


def payload(text: str) -> bytes:
    """UTF-8 bytes of a text, filled up with 255 to whole rows of WIDTH samples, one row at least."""
    raw = text.encode("utf-8", "replace")
    return raw + b"\xff" * (-len(raw) % WIDTH if raw else WIDTH)


def stored(data: bytes) -> bytes:
    """A binary greymap whose samples are the payload."""
    return b"P5\n%d %d\n255\n" % (WIDTH, len(data) // WIDTH) + data


def samples(media: bytes) -> bytes:
    """The payload read back from a greymap, by the sizes in its header."""
    magic, dims, depth, rest = media.split(b"\n", 3)
    w, h = map(int, dims.split())
    if magic != b"P5" or depth != b"255" or len(rest) != w * h:
        raise ValueError("not an 8-bit greymap")
    return rest


def media_of_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, digest, media): the stored form of every text."""

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 500):
                b = whole.iloc[at : at + 500]
                texts = ["" if t is None else t for t in b["text"]]
                forms = [stored(payload(t)) for t in texts]
                yield pd.DataFrame({
                    "id": b["id"].to_numpy(), "n_bytes": [len(t.encode("utf-8", "replace")) for t in texts],
                    "digest": [hashlib.sha256(x).hexdigest() for x in forms], "media": forms
                })

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(store, f"id {kind}, n_bytes long, digest string, media binary")


def features(media: DataFrame) -> DataFrame:
    """(digest, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of each stored form, once by digest.

    feature: rows, mean, and mean step between neighbouring samples, of the samples read back.
    """

    def read_back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            rows = []
            for m in whole["media"]:
                data = samples(m)
                x = np.frombuffer(data, np.uint8).astype(np.int16)
                feature = f"{len(x) // WIDTH}x{WIDTH}:{int(x.sum(dtype=np.int64)) * 1000 // len(x)}:{int(np.abs(np.diff(x)).sum(dtype=np.int64)) * 1000 // len(x)}"
                own = hashlib.sha256(m).hexdigest()
                rows.append((own, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(m), own, feature))
            yield pd.DataFrame(rows, columns=["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    seen = media.select("media").mapInPandas(
        read_back,
        "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )
    cols = [c for c in seen.columns if c != "digest"]
    return seen.groupBy("digest").agg(*[F.max(c).alias(c) for c in cols])


def resolve(pages: DataFrame, media: DataFrame, items_col: str = "items") -> DataFrame:
    """One row (columns of pages, pos, kind, text, digest, caption, columns of media) for each item, in place and captioned.

    media has one row for each digest. Columns of pages that share a name with an item's or the media's are dropped.
    """
    clash = {"pos", "kind", "text", "digest", "caption", *media.columns}
    items = pages.drop(*[c for c in pages.columns if c in clash]).select("*", F.inline(items_col)).drop(items_col)
    return items.join(media, "digest", "left")

