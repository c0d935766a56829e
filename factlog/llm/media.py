"""Media columns as interleaved document sequences.

HTML becomes an ordered sequence of text and media references; a reference names its payload by digest. Payloads lie in
a table of their own and are stored losslessly as PNG of 8-bit samples. A join on the digest resolves references; every
element keeps its position, and captions stay with the reference they describe.

Defined results: a null or empty html is an empty sequence; a reference whose digest has no payload stays in its place
with a null payload; repeated references and repeated rows each keep their own place; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import freeing, salted_join, stored

#: Bytes in a row of samples: 64 pixels of three 8-bit samples.
ROW = 192
SIGNATURE = b"\x89PNG\r\n\x1a\n"
ELEMENTS = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"
#: Tags whose text is no part of the document, tags that end a stretch of text, and those that leave an open head open.
SILENT = {"script", "style", "template", "noscript"}
INLINE = {"a", "abbr", "b", "code", "em", "i", "mark", "q", "s", "small", "span", "strong", "sub", "sup", "u"}
HEAD = {"title", "meta", "link", "base"} | SILENT


class _Sequence(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.text: list[str] = []
        self.silent = 0
        self.head = self.title = self.body = False
        self.figures: list[tuple[int, list[dict]]] = []  # where each open figure's elements begin, and its captions
        self.caption: list[str] | None = None
        self.captioned: set[int] = set()

    def end_text(self) -> None:
        if self.caption is not None:
            self.caption.append(" ")
            return
        said = " ".join("".join(self.text).split())
        self.text = []
        if said:
            self.out.append({"kind": "text", "text": said, "digest": None, "caption": None})

    def end_caption(self) -> None:
        """The caption stands as a text in its place until its figure ends."""
        if self.caption is not None:
            self.text, self.caption = self.caption, None
            before = len(self.out)
            self.end_text()
            self.figures[-1][1].extend(self.out[before:])

    def end_figure(self) -> None:
        """Media without a nearer caption take the figure's; if there are none, it stays a text."""
        self.end_caption()
        self.end_text()
        start, captions = self.figures.pop()
        media = [x for x in self.out[start:] if x["kind"] == "media" and id(x) not in self.captioned]
        if captions and media:
            said = " ".join(x["text"] for x in captions)
            for x in media:
                x["caption"] = said
                self.captioned.add(id(x))
            self.out[start:] = [x for x in self.out[start:] if not any(x is c for c in captions)]

    def end_head(self) -> None:
        self.head = self.title = False
        self.body = True

    def end(self) -> None:
        while self.figures:
            self.end_figure()
        self.end_text()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "head":
            self.head = not self.body
            return
        if tag not in HEAD and tag != "html" and not self.silent:
            self.end_head()  # its end tag may be left out
        if tag in SILENT:
            self.silent += 1
        elif tag == "title" and self.head:
            self.title = True
        elif tag in ("img", "video", "audio", "source"):
            self.end_text()
            at = dict(attrs)
            if at.get("src"):
                self.out.append({"kind": "media", "text": None, "digest": at["src"].removeprefix("sha256:"), "caption": at.get("alt") or None})
        elif tag == "figure":
            self.end_caption()
            self.end_text()
            self.figures.append((len(self.out), []))
        elif tag == "figcaption":
            self.end_caption()
            self.end_text()
            if self.figures:  # outside a figure it is a text like others
                self.caption = []
        elif tag not in INLINE:
            self.end_text()

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "head" and self.head:
            self.end_head()
        elif tag == "title":
            self.title = False
        elif tag == "figcaption" and self.caption is not None:
            self.end_caption()
        elif tag == "figure" and self.figures:
            self.end_figure()
        elif tag in ("body", "html"):
            self.end()
        elif tag not in INLINE:
            self.end_text()

    def handle_data(self, data: str) -> None:
        if self.silent or self.title or self.head and not data.strip():
            return
        if self.head:
            self.end_head()
        (self.text if self.caption is None else self.caption).append(data)


def parse(html: str | None) -> list[dict]:
    """The elements of one page in order; captions of a figure belong to all its media."""
    p = _Sequence()
    p.feed(html or "")
    p.close()
    p.end()
    return [{"position": k} | x for k, x in enumerate(p.out)]


def sequence_of(html: str) -> Column:
    """The column's pages as arrays of elements."""
    return F.pandas_udf(lambda pages: pages.map(parse), ELEMENTS)(html)


def resolve(sequences: DataFrame, payloads: DataFrame, id_col: str | list[str], sequence_col: str = "sequence", digest_col: str = "digest") -> DataFrame:
    """id (a column, or several that belong together) and elements: the sequence again, each element with payload, the row of payloads for its digest (null where there is none).

    payloads may repeat a digest: equal digests are equal payloads, and one row of each is used. Only references take
    part in the join; those to a digest that very many elements name are dealt out over several tasks.
    """
    ids = [id_col] if isinstance(id_col, str) else id_col
    each = sequences.select(*[F.col(c).alias(f"_id{k}") for k, c in enumerate(ids)], F.explode_outer(sequence_col).alias("e"))
    each = stored(each.withColumn("_digest", F.col("e.digest")), "elements")
    columns = [c for c in payloads.columns if c != digest_col]
    one = payloads.filter(F.col(digest_col).isNotNull()).groupBy(F.col(digest_col).alias("_digest")).agg(F.min(F.struct(*columns)).alias("payload"))
    rows = salted_join(each.filter("_digest is not null"), one, "_digest", "left").unionByName(each.filter("_digest is null"), allowMissingColumns=True)
    element = F.struct("e.position", "e.kind", "e.text", "e.digest", "e.caption", "payload")
    both = rows.groupBy(*[F.col(f"_id{k}").alias(c) for k, c in enumerate(ids)])
    return both.agg(F.sort_array(F.collect_list(F.when(F.col("e").isNotNull(), element))).alias("elements"))


def png(payload: bytes, row: int = ROW) -> bytes:
    """The payload as an 8-bit RGB image of row / 3 pixels in width, without loss."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, row)
    lines = np.zeros((len(rows), row + 1), np.uint8)  # each line begins with its filter type, none
    lines[:, 1:] = rows
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", row // 3, len(rows), 8, 2, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 4)) + chunk(b"IEND", b"")


def samples(image: bytes) -> np.ndarray:
    """The samples of an image that png() made, one row for each of its lines; checksums are verified."""
    if image[:8] != SIGNATURE:
        raise ValueError("not a PNG image")
    at, data, width, height = 8, [], 0, 0
    while at < len(image):
        (size,) = struct.unpack_from(">I", image, at)
        kind, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", image, at + 8 + size)[0]:
            raise ValueError(f"chunk {kind!r} is damaged")
        if kind == b"IHDR":
            width, height, *form = struct.unpack(">IIBBBBB", body)
            if form != [8, 2, 0, 0, 0]:
                raise ValueError(f"unexpected form {form}")
        elif kind == b"IDAT":
            data.append(body)
        at += size + 12
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, 3 * width + 1)
    if lines[:, 0].any():
        raise ValueError("unexpected filter")
    return lines[:, 1:]


def payload_of(text: str | None, row: int = ROW) -> bytes:
    """UTF-8 with spaces up to a positive multiple of row."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data.ljust(max(row, -(-len(data) // row) * row), b" ")


def feature_of(rows: np.ndarray) -> str:
    """Mean, deviation, entropy of the samples and the mean step between neighbours."""
    flat = rows.ravel()
    counts = np.bincount(flat, minlength=256)
    p = counts[counts > 0] / flat.size
    value = np.nonzero(counts)[0]
    mean = float((p * value).sum())
    deviation = float(((p * (value - mean) ** 2).sum()) ** 0.5)
    step = float(np.abs(np.diff(flat.astype(np.int16))).mean())
    return f"mean={mean:.4f};deviation={deviation:.4f};entropy={float(-(p * np.log2(p)).sum()):.4f};step={step:.4f}"


@freeing
def _encoded(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: set[bytes] = set()  # digests whose image this task has written
    for df in parts:
        for start in range(0, len(df), 512):  # a few megabytes at a time
            part = df.iloc[start : start + 512]
            payloads = [payload_of(t) for t in part["text"]]
            images = [png(p) for p in payloads]
            digests = [hashlib.sha256(x).hexdigest() for x in images]
            sizes = [len((t or "").encode("utf-8", "surrogatepass")) for t in part["text"]]
            html = [f'<article><p>Text of {n} bytes</p><figure><img src="sha256:{d}"><figcaption>{len(p) // ROW} lines</figcaption></figure></article>' for n, d, p in zip(sizes, digests, payloads)]
            kept = []
            for digest, image in zip(digests, images):
                short = bytes.fromhex(digest)[:16]
                kept.append(None if short in seen else image)
                seen.add(short)
            yield pd.DataFrame({"rid": part["rid"], "id": part["id"], "n_bytes": sizes, "html": html, "digest": digests, "media": kept})


def as_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rid, id, n_bytes, html, digest, media: every text as an image and a page that refers to it, stored in the shared folder.

    A task that meets a digest again leaves media null there: of equal texts it stores one image.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInPandas(_encoded, f"rid long, id {kind}, n_bytes long, html string, digest string, media binary")
    return stored(out, "media", compression="none")


@freeing
def _read_back(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in parts:
        rows = []
        for digest, media in zip(df["digest"], df["media"]):
            lines = samples(media)
            payload = lines.tobytes()
            rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(lines)))
        yield pd.DataFrame(rows, columns=["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def features(media: DataFrame) -> DataFrame:
    """digest and what the stored bytes hold, read back image by image; no payload leaves its task."""
    return media.filter("media is not null").select("digest", "media").mapInPandas(_read_back, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
