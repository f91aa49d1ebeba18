"""Interleaved document sequences: pages become ordered text and media items, digests resolve payloads.

A page's HTML is parsed into items in reading order; an image item names its payload by digest and keeps
its caption. Payloads are stored once for each digest, losslessly, as the 8-bit grey samples of a PNG file
written here; what a digest join brings to each item is computed from the stored bytes after reading them back.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm.common import salted_lookup, written
from rowloom.llm.textkernel import column_bytes, passages
from rowloom.sources.tables import table

#: Samples of a stored row; payloads fill a whole positive number of rows, with FILL at the end.
WIDTH, FILL, TAIL = 576, 255, 32
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


# --- the stored form -----------------------------------------------------------------------------


def payload(raw: bytes) -> bytes:
    """raw and bytes FILL up to a positive multiple of WIDTH."""
    return raw + bytes([FILL]) * (-len(raw) % WIDTH or (0 if raw else WIDTH))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(samples: bytes) -> bytes:
    """An 8-bit grey PNG, WIDTH samples a row, every row unfiltered."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(stored: bytes) -> np.ndarray:
    """The samples of a file of to_png(), by rows; checks its chunks' sums."""
    if stored[:8] != _SIGNATURE:
        raise ValueError("not a PNG file")
    at, head, body = 8, b"", []
    while at < len(stored):
        size, kind = struct.unpack(">I4s", stored[at : at + 8])
        part = stored[at + 8 : at + 8 + size]
        if struct.unpack(">I", stored[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + part):
            raise ValueError(f"damaged chunk {kind!r}")
        if kind == b"IHDR":
            head = part
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + size
    width, height, *form = struct.unpack(">IIBBBBB", head)
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    if form != [8, 0, 0, 0, 0] or lines[:, 0].any():
        raise ValueError("only unfiltered 8-bit grey rows are read")
    return lines[:, 1:]


def feature(samples: np.ndarray) -> str:
    """Size, mean, and a 64-bit difference hash over nine by eight patches, all in whole numbers."""
    flat = samples.ravel().astype(np.int64)
    edges = np.linspace(0, len(flat), 73).astype(int)
    sums = np.concatenate(([0], np.cumsum(flat)))
    means = (sums[edges[1:]] - sums[edges[:-1]]) * 256 // np.maximum(np.diff(edges), 1)
    grid = means.reshape(8, 9)
    bits = "".join("1" if x else "0" for x in (grid[:, 1:] > grid[:, :-1]).ravel())
    return f"{samples.shape[1]}x{samples.shape[0]} mean {int(flat.sum()) * 1000 // len(flat)} dhash {int(bits, 2):016x}"


# --- pages ---------------------------------------------------------------------------------------

#: Elements that end a run of text, and elements whose content is not text.
_BLOCKS = frozenset("address article aside blockquote body br dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table td th title tr ul".split())
_HIDDEN = frozenset(("script", "style", "template", "noscript", "head"))


class _Items(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[tuple[str, str, str]] = []  # kind, text or reference, caption
        self.run: list[str] = []
        self.hidden = 0
        self.in_caption = False
        self.figure: int | None = None

    def flush(self) -> None:
        text = "".join(self.run).strip()
        self.run = []
        if not text:
            return
        if self.in_caption and self.figure is not None and self.figure < len(self.items) and self.items[self.figure][0] == "media":
            kind, ref, _ = self.items[self.figure]
            self.items[self.figure] = (kind, ref, text)
        else:
            self.items.append(("text", text, ""))

    def handle_starttag(self, tag, attrs):
        if tag in _HIDDEN:
            self.hidden += 1
        if tag in _BLOCKS:
            self.flush()
        if tag in ("img", "video", "audio", "source") and not self.hidden:
            got = dict(attrs)
            if got.get("src"):
                self.flush()
                self.figure = len(self.items)
                self.items.append(("media", got["src"], got.get("alt") or ""))
        elif tag == "figure":
            self.figure = None
        elif tag == "figcaption":
            self.in_caption = True

    def handle_endtag(self, tag):
        if tag in _BLOCKS:
            self.flush()
        if tag in _HIDDEN and self.hidden:
            self.hidden -= 1
        if tag == "figcaption":
            self.in_caption = False

    def handle_data(self, data):
        if not self.hidden:
            self.run.append(data)


def parse(html: str) -> list[tuple[str, str, str]]:
    """(kind, text or reference, caption) in reading order; a figcaption replaces its image's alt text."""
    reader = _Items()
    reader.feed(html)
    reader.close()
    reader.flush()
    return reader.items


ITEM = "array<struct<position:int,kind:string,text:string,ref:string,caption:string>>"
_ITEM = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))


def sequences(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages without html, plus items: its text and media items in reading order, positions from 0.

    A null or empty page has no items; a page whose markup is broken gives what the parser makes of it.
    """
    kept = pages.drop("items")
    others = [f for f in kept.schema if f.name != html]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            _, at = column_bytes(column)
            for a, b in passages(at):
                rows = []
                for page in column.slice(a, b - a).to_pylist():
                    found = enumerate(parse(page or ""))
                    rows.append([{"position": p, "kind": k, "text": x if k == "text" else None, "ref": x if k == "media" else None, "caption": c if k == "media" else None} for p, (k, x, c) in found])
                columns = {f.name: batch.column(i).slice(a, b - a) for i, f in enumerate(others)}
                yield pa.RecordBatch.from_pydict(columns | {"items": pa.array(rows, _ITEM)})

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), f"items {ITEM}"])
    return kept.select(*[f.name for f in others], html).mapInArrow(run, schema)


def store(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """(digest, stored): the PNG of each distinct payload of a text column, named by the payload's SHA-256.

    A null text is an empty one, whose payload is one row of FILL; equal texts, and repeated rows, share one
    file; an empty table gives none. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, at = column_bytes(batch.column(0))
            for a, b in passages(at):
                digests, files = [], []
                for i in range(a, b):
                    p = payload(buf[at[i] : at[i + 1]].tobytes())
                    digests.append(hashlib.sha256(p).hexdigest())
                    files.append(to_png(p))
                yield pa.RecordBatch.from_arrays([pa.array(digests), pa.array(files, pa.binary())], ["digest", "stored"])

    made = rows.select(F.coalesce(F.col(raw), F.lit(""))).mapInArrow(run, "digest string, stored binary")
    return made.groupBy("digest").agg(F.first("stored").alias("stored"))


def inspect(media: DataFrame) -> DataFrame:
    """(digest, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature), read back from stored.

    A row for each row of media, repeated ones too; a file that is damaged, or not of to_png(), raises.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for stored in batch.column(1):
                raw = stored.as_py()
                samples = from_png(raw)
                p = samples.tobytes()
                found = (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-TAIL:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(samples))
                for column, v in zip(out, found, strict=True):
                    column.append(v)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip(out, kinds, strict=True))], names)

    schema = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("digest", "stored").mapInArrow(run, schema)


def resolve(pages: DataFrame, known: DataFrame) -> DataFrame:
    """A row for each media item of pages (with items): pages' other columns, n_items, position, caption,
    digest and known's columns for it; an item whose digest is not known has nulls there.

    References are "sha256:" and a digest. A digest that very many items name is salted. Pages without
    media items give no row; repeated pages give their rows each; an empty table gives an empty result.
    """
    others = [c for c in pages.columns if c != "items"]
    items = pages.select(*others, F.size("items").alias("n_items"), F.explode(F.filter("items", lambda i: i["kind"] == "media")).alias("_item"))
    refs = items.select(*others, "n_items", F.col("_item.position").alias("position"), F.col("_item.caption").alias("caption"), F.regexp_extract("_item.ref", "^sha256:([0-9a-f]{64})$", 1).alias("digest"))
    return salted_lookup(written(refs), known, "digest")  # written: pages are parsed once, the join reads the items twice


def _escaped(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def pages_of(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, n_bytes, html): a page for each document, a paragraph a line, then a figure with its payload."""
    raw = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_col), raw.alias("_text"), F.octet_length(raw).cast("long").alias("n_bytes"))
    fill = F.when(F.col("n_bytes") == 0, F.lit(WIDTH)).otherwise(F.pmod(-F.col("n_bytes"), F.lit(WIDTH))).cast("int")
    padded = F.concat(F.col("_text").cast("binary"), F.unhex(F.repeat(F.lit(f"{FILL:02x}"), fill)))
    body = F.replace(_escaped(F.col("_text")), F.lit("\n"), F.lit("</p><p>"))
    figure = F.concat(F.lit('</p><figure><img src="sha256:'), F.sha2(padded, 256), F.lit('"><figcaption>'), F.concat(F.col("n_bytes").cast("string"), F.lit(" bytes")), F.lit("</figcaption></figure>"))
    return rows.select(id_col, "n_bytes", F.concat(F.lit("<p>"), body, figure).alias("html"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents; equal texts share one stored payload."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pages = sequences(pages_of(docs))
    # the texts of the items are not needed for the digest columns
    slim = pages.withColumn("items", F.transform("items", lambda i: F.struct(i["position"].alias("position"), i["kind"].alias("kind"), i["ref"].alias("ref"), i["caption"].alias("caption"))))
    found = resolve(slim, inspect(store(docs, "text")))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_items", "position", "caption")
