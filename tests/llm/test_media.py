"""Media columns: exact round trips, alignment of interleaved sequences."""

import hashlib
import re
import zlib
from html import unescape

from factlog.llm import media
from factlog.llm.queries import op8_media


def test_parse_keeps_order_and_captions():
    html = "<html><head><title>no</title></head><body><p>One &amp; two <b>three</b></p><figure><img src='sha256:aa'><img src=bb><figcaption>Both\n of them</figcaption></figure>tail<script>x='<p>'</script><img alt='c' src='cc'>"
    got = [(x["position"], x["kind"], x["text"], x["digest"], x["caption"]) for x in media.parse(html)]
    assert got == [(0, "text", "One & two three", None, None), (1, "media", None, "aa", "Both of them"), (2, "media", None, "bb", "Both of them"), (3, "text", "tail", None, None), (4, "media", None, "cc", "c")]
    assert media.parse(None) == [] and media.parse("") == []


def test_parse_loses_no_text():
    said = lambda html: [(x["text"] or x["digest"], x["caption"]) for x in media.parse(html)]
    assert said("<html><head><title>no</title><style>p{}</style><body><p>One</p>two") == [("One", None), ("two", None)]
    assert said("<head><title>no</title><meta charset=x><p>One</p>") == [("One", None)]
    assert said("<figure><table><tr><td>1</td></tr></table><figcaption>Of a table</figcaption></figure>") == [("1", None), ("Of a table", None)]
    assert said("a<figcaption>Outside</figcaption>b") == [("a", None), ("Outside", None), ("b", None)]
    assert said("<figcaption>Open<p>rest") == [("Open", None), ("rest", None)]
    assert said("<figure><img src=x><figcaption>Open</figure>rest") == [("x", "Open"), ("rest", None)]
    assert said("<figure><img src=x><figcaption>Open<p>rest") == [("x", "Open rest")]
    assert said("<figure><figcaption>First</figcaption><img src=x></figure>") == [("x", "First")]
    assert said("<figure><figure><img src=x><figcaption>In</figcaption></figure><img src=y><figcaption>Out</figcaption></figure>") == [("x", "In"), ("y", "Out")]


def test_pages(spark, sf):
    """All words of real pages, with their end of the head left out as well."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html")
    got = {r.page_id: r.elements for r in media.resolve(pages.select("page_id", media.sequence_of("html").alias("sequence")), spark.createDataFrame([], "digest string, media binary"), "page_id").collect()}
    for r in pages.collect():
        html = r.html or ""
        body = re.sub(r"(?s)<!--.*?-->|<(script|style|template|noscript)\b.*?</\1>", "", html.partition("</head>")[2] or html)
        want = "".join(unescape(re.sub(r"<[^>]*>", " ", body)).split())
        assert "".join("".join((x.text or "") for x in got[r.page_id]).split()) == want
        assert [x["text"] for x in media.parse(html.replace("</head>", ""))] == [x.text for x in got[r.page_id]]


def test_png_round_trip():
    for text in (None, "", "a", "é" * 96, "x" * 192, "☃ line\n" * 5000):
        payload = media.payload_of(text)
        assert len(payload) % 192 == 0 and len(payload) >= 192
        assert media.samples(media.png(payload)).tobytes() == payload


def test_resolve(spark):
    pages = spark.createDataFrame([(1, "<p>a</p><img src=x><p>b</p><img src=gone><img src=x>"), (2, None), (3, ""), (4, "<img src=y>")], "id long, html string")
    payloads = spark.createDataFrame([("x", b"X", 1), ("x", b"X", 1), ("y", b"Y", 2), (None, b"N", 3)], "digest string, media binary, text int")
    out = {r.id: r.elements for r in media.resolve(pages.select("id", media.sequence_of("html").alias("sequence")), payloads, "id").collect()}
    assert [(e.position, e.kind, e.text, e.payload and bytes(e.payload.media)) for e in out[1]] == [(0, "text", "a", None), (1, "media", None, b"X"), (2, "text", "b", None), (3, "media", None, None), (4, "media", None, b"X")]
    assert out[2] == [] and out[3] == [] and bytes(out[4][0].payload.media) == b"Y"


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op8_media(spark, sf).collect()
    assert len(rows) == len(texts)
    same = {}
    for r in rows:
        data = texts[r.doc_id].encode()
        payload = data + b" " * (max(192, -(-len(data) // 192) * 192) - len(data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert same.setdefault(texts[r.doc_id], (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)


def test_edges(spark, tmp_path):
    rows = [(1, None, 0), (1, None, 0), (None, "", 1), (2, "a" * 50_000, 2)]
    spark.createDataFrame(rows, "doc_id long, text string, rid int").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r.n_bytes for r in op8_media(spark, str(tmp_path)).collect()) == [0, 0, 0, 50_000]
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert op8_media(spark, f"{tmp_path}/none").count() == 0
