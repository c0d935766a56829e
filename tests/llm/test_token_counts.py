"""Token counts after edits against counting the edited text from scratch."""

import random
import zlib

import pytest

from factlog.llm import token_counts as tc
from factlog.llm.queries import op7_token_counts, vocabulary


@pytest.fixture(scope="module")
def count():
    return tc.counter(vocabulary())


def text(rng, n):
    return "".join(rng.choice(["a", "b", "é", "Z", "1", "23", " ", "  ", "\n", " \n", "'s", "'", "re", "!", "☃", "the ", " of"]) for _ in range(n))


@pytest.mark.parametrize("seed", range(6))
def test_random_edits(count, seed):
    rng = random.Random(seed)
    now = text(rng, rng.choice([0, 3, 50, 900]))
    tree = tc.Tree(now, count)
    for _ in range(150):
        start, drop, put = rng.randrange(len(now) + 3), rng.choice([0, 1, 2, 9, 200]), text(rng, rng.choice([0, 1, 2, 30, 300]))
        tree.edit(start, drop, put)
        now = now[:start] + put + now[start + drop :]
        assert tree.text == now and tree.total == len(count.encoding.encode_ordinary(now))
        words, leaves = tc.SPLIT.findall(now), tree.leaves()
        assert [n for x in leaves for n in x.lengths] == list(map(len, words)) and [n for x in leaves for n in x.counts] == count.counts(words)
        sums(tree.root)
    again = tc.Tree.of([{"text": x.text, "lengths": x.lengths, "counts": x.counts} for x in tree.leaves()], count)
    assert again.text == now and again.total == tree.total


def sums(node):
    """Every node's sums are those of its children, and all leaves lie at one depth, which is returned."""
    if isinstance(node, tc.Leaf):
        assert (node.chars, node.tokens, node.n) == (len(node.text), sum(node.counts), len(node.lengths)) and 0 < node.n <= 2 * tc.LEAF
        return 0
    assert [node.chars, node.tokens, node.n, node.leaves] == [sum(getattr(c, k) for c in node.children) for k in ("chars", "tokens", "n", "leaves")]
    assert len(node.children) <= 2 * tc.FAN
    depths = {sums(c) for c in node.children} or {0}
    assert len(depths) == 1
    return depths.pop() + 1


def test_an_edit_makes_only_its_path_anew(count):
    """Insertions and deletions too leave all other leaves and subtrees as they are."""
    tree = tc.Tree("some words in a line. " * 20_000, count)
    for start, drop, put in ((200_000, 3, "xyz"), (200_000, 0, " six more words than there were"), (300_000, 50, "")):
        before, nodes = {id(x): x for x in tree.leaves()}, {id(c): c for c in tree.root.children}
        tree.edit(start, drop, put)
        assert sum(id(x) not in before for x in tree.leaves()) <= 3 and len(tree.root.children) == len(nodes)
        sums(tree.root)


def test_edits_of_stored_states(spark, count):
    rng = random.Random(8)
    texts = [(k, text(rng, rng.choice([0, 5, 400, 3000]))) for k in range(12)] + [(12, None)]
    states = tc.states(spark.createDataFrame(texts, "doc_id long, text string"), vocabulary())
    edits = [(k, [(rng.randrange(50), rng.choice([0, 3, 60]), text(rng, 5)) for _ in range(3)]) for k, _ in texts]
    both = states.join(spark.createDataFrame(edits, "id long, edits array<struct<start:int,drop:int,put:string>>"), "id")
    for r in tc.counted_again(both, vocabulary()).collect():
        now = dict(texts)[r.id] or ""
        assert r.tokens_before == len(count.encoding.encode_ordinary(now))
        for start, drop, put in dict(edits)[r.id]:
            now = now[: min(start, len(now))] + put + now[start + drop :]
        assert "".join(x.text for x in r.state) == now and r.tokens_after == len(count.encoding.encode_ordinary(now)) and r.chars_after == len(now)


def test_only_the_region_is_encoded(count):
    tree = tc.Tree("some words in a line. " * 20_000, count)
    assert tree.edit(200_000, 3, "xyz") < 12 and tree.edit(7, 0, " more") < 12
    assert tree.total == len(count.encoding.encode_ordinary(tree.text))


def test_edges(spark):
    rows = [(1, None, [(0, 0, "new text")]), (2, "", None), (3, "abc def", [(0, 99, "")]), (3, "abc def", [(0, 99, "")]), (None, "x" * 50_000, [(25_000, 1, " ")]), (4, "a b", [(-5, 1, "q"), (99, 5, "end")])]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, edits array<struct<start:int,drop:int,put:string>>, tokens_before int")
    out = tc.counted(df, vocabulary()).collect()
    assert len(out) == len(rows) and out[0].chars_after == 8 and out[1].tokens_after == 0 and out[2].tokens_after == 0
    assert tc.counted(df.limit(0), vocabulary()).count() == 0


def test_query(spark, sf, count):
    texts = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    from factlog.llm.queries import edits_of

    edits = {r.doc_id: r.edits for r in edits_of(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    for r in op7_token_counts(spark, sf).collect():
        now = texts[r.doc_id].text
        assert r.tokens_before == len(count.encoding.encode_ordinary(now))
        for e in edits[r.doc_id]:
            now = now[: e.start] + e.put + now[e.start + e.drop :]
        assert (r.tokens_after, r.chars_after, r.text_crc32) == (len(count.encoding.encode_ordinary(now)), len(now), zlib.crc32(now.encode()))
