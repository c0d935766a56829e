"""The pipeline's stages, each on its own input, against plain versions."""

import corpus_pipeline
from factlog.llm import toxicity
from factlog.llm.common import stored
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_ngram_join import brute as brute_groups


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, sf), "test")
        before, after = rows(docs), rows(out) if name != "pieces" else None
        if name != "pieces":
            assert out.columns == docs.columns
        if name == "toxicity":
            scores = {r["_row"]["doc_id"]: r["score"] for r in toxicity.scored(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
            assert sorted(after) == sorted((i, t) for i, t in before if scores[i] < 0.5) and len(after) > 0.8 * len(before)
        elif name == "line dedup":
            assert sorted(after) == sorted(brute_lines(before))
        elif name == "n-gram join":
            assert sorted(i for i, _ in after) == sorted(i for i, _, c in brute_groups(before) if i == c)
        elif name == "mixing":
            words = sum(len(t.split()) for _, t in before)
            assert set(after) <= set(before) and abs(sum(len(t.split()) for _, t in after) - words) < 0.1 * words
            assert max(after.count(x) for x in set(after)) <= 3
        else:
            assert sorted(r.doc_id for r in out.collect()) == sorted(i for i, _ in before) and out.filter("not lossless").count() == 0
        docs = out


def test_near_copies_edges(spark):
    rows = [(1, None), (1, None), (2, "a b c d e f"), (3, "A b c d e f"), (2, "a b c d e f"), (None, "z y x"), (4, "")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    out = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted([(1, None), (2, "a b c d e f"), (None, "z y x"), (4, "")], key=repr)
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), "").count() == 0


def test_near_copies_with_repeated_ids(spark):
    """Of each group one row stays, although its id repeats with texts of other groups."""
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    near = lambda text: f"{text} end"
    rows = [(5, a), (5, b), (3, near(b)), (7, c), (7, near(c)), (7, c.upper()), (None, d), (None, near(a)), (None, d.replace("d", "e")), (6, None), (6, "")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    out = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    sevens = [r for r in out if r[0] == 7]
    assert len(sevens) == 1 and sevens[0] in rows
    assert sorted((r for r in out if r[0] != 7), key=repr) == sorted([(5, a), (3, near(b)), (None, d), (None, d.replace("d", "e")), (6, None), (6, "")], key=repr)


CLASHING = ("_text", "_id", "_row", "_place", "_key", "key", "node", "id", "component", "kept", "size", "score", "hash", "rid", "target", "pieces", "_lines")


def test_edges_of_every_stage(spark, sf):
    """Columns with names that the stages use come through as they were; nulls, empty and long texts, ties and repeated rows; empty tables."""
    texts = [None, "", "\n", "one two three four five six", "one two three four five six", "x" * 30_000 + " end", "a line of words that is shared\nown 1", "a line of words that is shared\nown 2"]
    rows = [(None if k == 2 else k // 2 if k > 5 else k, t, None if k % 3 == 0 else "s", *("mine" for _ in CLASHING)) for k, t in enumerate(texts)]
    rows.append(rows[3])
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in CLASHING))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert stage(spark, docs.limit(0), sf).count() == 0
        if name == "pieces":
            assert out.count() == len(rows) and out.filter("not lossless").count() == 0
            continue
        assert out.columns == docs.columns and out.schema == docs.schema
        found = out.collect()
        assert found and all(r[c] == "mine" for r in found for c in CLASHING), name
        if name in ("toxicity", "line dedup"):
            assert len(found) == len(rows)
        if name == "n-gram join":
            assert sorted(r.doc_id for r in found if r.text and r.text.startswith("one")) == [3]
