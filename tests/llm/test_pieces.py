"""SentencePiece segmentation against brute force over all paths, and exact round trips."""

import itertools
import random
import subprocess
import sys

import numpy as np
import pytest

from factlog.llm import pieces
from factlog.llm.queries import op1_sentencepiece, piece_model


@pytest.fixture(scope="module")
def model():
    return pieces.Model(piece_model())


def all_paths(m, text):
    """(score, pieces) of every path through the whole text's lattice."""
    marked = (" " + text if text else "").replace(" ", pieces.SPACE_MARK)
    arcs = m.arcs(marked)
    at = {0: [(0.0, ())]}
    for end in range(1, len(marked) + 1):
        at[end] = [(s + score, p + put) for start, score, put in arcs[end] for s, p in at[start]]
    return sorted(at[len(marked)], key=lambda x: -x[0])


def taken(best, changes):
    out = list(best)
    for c in sorted(changes, key=lambda c: -c["at"]):
        out[c["at"] : c["at"] + c["drop"]] = c["put"]
    return out


@pytest.mark.parametrize("text", ["hello wor", "", " ", "   a  b", "a", "aaaaaaa", "été ☃ x", "the cat\nsat", "\n\n", "ing ing", "\t", "▁ a"])
def test_n_best_against_all_paths(model, text):
    want = all_paths(model, text)
    flat, lengths, scores, others = pieces.encode(model, [text], 5)
    assert scores[0] == pytest.approx(want[0][0])
    got = [(scores[0], flat.tolist())] + [(o["score"], taken(flat.tolist(), o["changes"])) for o in others[0]]
    assert len(got) == min(6, len(want)) and len({tuple(p) for _, p in got}) == len(got)
    assert [s for s, _ in got] == pytest.approx([s for s, _ in want[: len(got)]])
    real = {p: s for s, p in want}
    assert all(real[tuple(p)] == pytest.approx(s) for s, p in got)


def test_batches_do_not_matter(model):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdeé ☃\n\t▁ü ") for _ in range(rng.randrange(60))) for _ in range(200)]
    flat, lengths, scores, others = pieces.encode(model, texts, 3)
    back = pieces.decode(model, flat, lengths)
    assert all(b == t.encode() for b, t in zip(back, texts) if "▁" not in t)
    ends = np.concatenate(([0], np.cumsum(lengths)))
    fresh = pieces.Model(piece_model())
    for k in range(0, 200, 20):
        one = pieces.encode(fresh, [texts[k]], 3)
        assert one[0].tolist() == flat[ends[k] : ends[k + 1]].tolist() and one[2][0] == scores[k] and one[3][0] == others[k]


def test_ways_are_in_order(model):
    for word in ("▁understanding", "▁aaaaaaaaaaaaaaaaaaaaaaaa", "▁" * 30 + "x"):
        ways = model.ways(word, 20)
        assert len({p for _, p in ways}) == len(ways) and [s for s, _ in ways] == sorted((s for s, _ in ways), reverse=True)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "😀 emoji"), (4, "x" * 20_000), (5, "w " * 20_000)]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double")
    out = pieces.encoded(docs, piece_model())
    got = out.collect()
    assert len(got) == len(rows) and [r.pieces is None for r in got] == [t is None for _, t in rows]
    assert [r.lossless for r in got] == [None if t is None else True for _, t in rows]
    assert {(r.id, r.text) for r in pieces.decoded(out, piece_model()).collect()} == set(rows)
    assert pieces.encoded(docs.limit(0), piece_model()).count() == 0


WORKER = """
import random, re
from pathlib import Path
import pandas, pyarrow as pa
from factlog.llm import pieces
from factlog.llm.queries import piece_model

def mb(what):
    return int(re.search(what + r":\\s+(\\d+)", Path("/proc/self/status").read_text())[1]) / 1024

rng = random.Random(1)
words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 8))) for _ in range(20_000)]
texts = [" ".join(rng.choices(words, k=400)) for _ in range(8_000)]
batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
del texts
other = pa.struct([("score", pa.float64()), ("changes", pa.list_(pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("put", pa.list_(pa.int32()))])))])
schema = pa.schema([("id", pa.int64()), ("pieces", pa.list_(pa.int32())), ("score", pa.float64()), ("others", pa.list_(other)), ("lossless", pa.bool_())])
pieces.model(piece_model())
Path("/proc/self/clear_refs").write_text("5")  # the peak begins here
before, rows = mb("VmRSS"), 0
for out in pieces._encoding(piece_model(), 3, schema)(iter([batch])):
    rows += out.num_rows
print(rows, mb("VmHWM") - before, mb("VmRSS") - before)
"""


@pytest.mark.skipif(sys.platform != "linux", reason="memory is read from /proc")
def test_a_workers_memory():
    """A large batch takes little beside itself, and a worker keeps little of it when its partition ends."""
    rows, peak, kept = map(float, subprocess.run([sys.executable, "-c", WORKER], capture_output=True, text=True, check=True).stdout.split())
    assert rows == 8_000 and peak < 60 and kept < 40


def test_empty_and_long_texts_in_parts(model, monkeypatch):
    """Blocks of segments and pieces end anywhere."""
    rng = random.Random(2)
    texts = ["", "a" * 300, " ", *("".join(rng.choice("abé ☃\n") for _ in range(rng.randrange(40))) for _ in range(60)), "", "the end"]
    want = pieces.encode(pieces.Model(piece_model()), texts, 2)
    for block in (1, 2, 7):
        monkeypatch.setattr(pieces, "BLOCK", block)
        got = pieces.encode(pieces.Model(piece_model()), texts, 2)
        assert all(np.array_equal(x, y) for x, y in zip(got[:3], want[:3])) and got[3] == want[3]
        assert pieces.decode(model, got[0], got[1]) == [t.encode() for t in texts]


def test_query(spark, sf):
    rows = op1_sentencepiece(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.lossless and r.n_pieces == len(r.pieces) for r in rows)
    assert all(list(itertools.accumulate([r.score] + [o.score for o in r.others], min)) == [r.score] + [o.score for o in r.others] for r in rows)
