"""Toxicity: held-out accuracy, what scores may not depend on, and edges."""

import random
import zlib

import pytest

from factlog.llm import toxicity
from factlog.llm.queries import op2_toxicity

ROWS = "doc_id long, text string, score double, toxic int"


@pytest.fixture(scope="module")
def corpus(spark):
    """Half the toxic texts hold an insult, half a made-up word that only labels reveal."""
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(5, 80))]
        toxic = int(i % 6 == 0)
        if toxic:
            for _ in range(2):
                words[rng.randrange(len(words))] = rng.choice(["You idiot", "stupid"]) if i % 12 else f"zorblax{rng.randrange(50)}"
        rows.append((i, " ".join(words), toxic))
    return rows


def test_held_out_accuracy(spark, corpus):
    docs = spark.createDataFrame([(i, t, 9.0, 9) for i, t, _ in corpus], ROWS)
    labels = spark.createDataFrame([(i, y) for i, _, y in corpus] + [(77_777, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fitted(docs, labels)
    assert "zorbl-" in model.terms
    got = {r["_row"]["doc_id"]: r["score"] for r in model.score(docs).collect()}
    held = [(got[i], y) for i, _, y in corpus if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((s >= 0.5) == bool(y) for s, y in held) >= 0.97 * len(held)
    assert all(0 <= s <= 1 for s in got.values())
    edges = spark.createDataFrame([(1, None), (2, ""), (None, "You idiot"), (3, "x " * 50_000), (3, "x " * 50_000)], "doc_id long, text string")
    out = model.score(edges).collect()
    assert len(out) == 5 and out[0].score == out[1].score < 0.5 <= out[2].score and out[3].score == out[4].score


def test_held_out_labels_are_not_read(spark, corpus):
    docs = spark.createDataFrame([(i, t) for i, t, _ in corpus], "doc_id long, text string")
    told = [(i, y) for i, _, y in corpus]
    lied = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in told]
    a, b = ({r["_row"]["doc_id"]: r["score"] for r in toxicity.scored(docs, spark.createDataFrame(x, "doc_id long, toxic int")).collect()} for x in (told, lied))
    assert a == b


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "You idiot"), (2, "fine"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["_row"]["doc_id"]: r["score"] for r in toxicity.scored(docs, labels).collect()} == {1: 0.9, 2: 0.1, 3: 0.1}
    assert toxicity.scored(docs.limit(0), labels).count() == 0


def test_features():
    f = toxicity.features_of("You are an IDIOT! st*pid", lambda w: 0.0)
    assert f[0] == pytest.approx(1 / 6) and f[1] == 1 and f[7] > 0 and f[9] > 0 and f[11] > 0 and len(f) == toxicity.N_FEATURES
    assert toxicity.features_of(None, lambda w: 0.0) == toxicity.features_of("", lambda w: 0.0)


def test_query(spark, sf):
    rows = op2_toxicity(spark, sf).collect()
    assert len({r.doc_id for r in rows}) == len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in rows)
