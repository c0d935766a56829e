"""The n-gram join against brute force over all pairs."""

import random
import re

import numpy as np
import pandas as pd
import pytest

from factlog.llm import common, graph, hashing, ngram_join
from factlog.llm.queries import op3_ngram_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def brute(rows):
    """(id, size, component) of every row, by comparing all pairs of different sets."""
    sets = [frozenset(shingles(t)) for _, t in rows]
    up = {s: s for s in sets}

    def root(s):
        while up[s] is not s:
            s = up[s]
        return s

    different = list(up)
    for k, x in enumerate(different):
        for y in different[:k]:
            both = len(x & y)
            if x and y and 100 * both >= 80 * (len(x) + len(y) - both):
                up[root(x)] = root(y)
    least = {}
    for (i, _), s in zip(rows, sets):
        if s and i is not None:
            least[root(s)] = min(i, least.get(root(s), i))
    return sorted(((i, len(s), least.get(root(s)) if s else i) for (i, _), s in zip(rows, sets)), key=repr)


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, node int, n string")
    assert sorted(((r.id, r.n, r.component) for r in ngram_join.joined(docs).collect()), key=repr) == brute(rows)


def changed(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.random()}"
    return " ".join(words)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (9, "one TWO\n"), (5, "one two three four"), (6, "one two three four five"), (7, "ÉTÉ a b c d e"), (8, "été a b c d e"), (None, "one two"), (4, "One two"), (10, "a b " * 20_000), (11, "a b " * 20_001), (None, None), (12, "x" * 50_000), (13, "a b c d e f"), (14, "a b c d e f")]
    rows += [(None, "n1 n2 n3 n4 n5 n6 n7 n8 n9 n10 n11 n12 n13 n14 n15"), (None, "n1 n2 n3 n4 n5 n6 n7 n8 n9 n10 n11 n12 n13 n14 n15 n16"), (5, "n1 n2 n3 n4 n5 n6 n7 n8 n9 n10 n11 n12 n13 n14 n15 n16 n17")]
    check(spark, rows)
    assert ngram_join.joined(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_planted(spark):
    rng = random.Random(3)
    rows, passage = [], [f"p{k}" for k in range(60)]
    for group in range(25):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([6, 12, 25, 40, 80, 160, 400, 900]))]
        rows.append((len(rows), " ".join(words)))
        rows += [(len(rows) + k, changed(rng, words, rng.choice([0, 1, 1, 2, len(words) // 30, len(words) // 12]))) for k in range(8)]
    rows += [(len(rows) + k, " ".join(passage + [f"q{k}.{j}" for j in range(rng.randrange(5, 60))])) for k in range(60)]
    check(spark, rows)


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(60)]
    check(spark, [(k, changed(rng, words, 1) if k % 3 else " ".join(words)) for k in range(300)])


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    rng = random.Random(5)
    passage = [f"p{k}" for k in range(60)]
    rows = [(k, " ".join(passage + [f"q{k % 100}.{j}" for j in range(20 + k % 7)])) for k in range(200)]
    rows += [(1000 + k, changed(rng, passage, 1)) for k in range(40)]
    check(spark, rows)


def test_a_pair_of_many_buckets_is_named_in_the_first():
    rng = np.random.default_rng(7)
    base = np.unique(rng.integers(0, 2**64, 400, dtype=np.uint64))
    sets = [np.unique(np.append(base[rng.permutation(len(base))[: len(base) - 10]], rng.integers(0, 2**64, 10, dtype=np.uint64))) for _ in range(12)]
    signs = [np.sort(ngram_join.signatures(s).view(np.int64)) for s in sets]
    rows = [(s, 0, 0, k, k, 0, len(x), ngram_join.sketch_of(x), mine[: ngram_join.FIRSTS]) for k, (x, mine) in enumerate(zip(sets, signs)) for s in mine.tolist()]
    df = pd.DataFrame(rows, columns=["sign", "i", "j", "node", "component", "block", "n", "sketch", "firsts"]).sort_values("sign", ignore_index=True)
    together = {(a, b) for a in range(12) for b in range(a) if len(np.intersect1d(signs[a], signs[b]))}
    assert len(together) == 66 and sum(len(np.intersect1d(signs[a], signs[b])) for a, b in together) > 66 * 20
    each = [(max(a, b), min(a, b)) for _, bucket in df.groupby("sign") for found in ngram_join._nearest(bucket, 0) for a, b in found.to_numpy().tolist()]
    assert len(each) == 66 and set(each) == together


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_few_pairs_are_compared_with_one_shuffle(spark, tmp_path, monkeypatch):
    sets = [(k, list(range(k, 100))) for k in range(40)] * 2  # rows may repeat
    spark.createDataFrame(sets, "node long, members array<long>").write.parquet(f"{tmp_path}/sets")
    spark.createDataFrame([(0, k) for k in range(1, 40)], "a long, b long").write.parquet(f"{tmp_path}/pairs")
    pairs, sets = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("pairs", "sets"))
    few = ngram_join.similar(pairs, sets)
    assert shuffles(few) == 1
    wanted = [(0, k) for k in range(1, 21)]
    assert sorted(map(tuple, few.collect())) == wanted
    monkeypatch.setattr(ngram_join, "REPEATED", 100 * 8 * 39 - 1)  # the first set, as often as it has pairs
    dealt = ngram_join.similar(pairs, sets)
    assert shuffles(dealt) > 1 and sorted(map(tuple, dealt.collect())) == wanted
    monkeypatch.setattr(common, "SENT", 38)
    assert sorted(map(tuple, ngram_join.similar(pairs, sets).collect())) == wanted


def test_rounds_of_few_links_send_them(spark):
    spark.createDataFrame([(k + 1, k) for k in range(30)], "u long, v long").createOrReplaceTempView("some_links")
    edges = spark.table("some_links")
    assert shuffles(graph._small_star(graph._large_star(edges, True), True)) < shuffles(graph._small_star(graph._large_star(edges, False), False))
    star = lambda rows: sorted(r.k for r in graph._unfinished(spark.createDataFrame(rows, "u long, v long")).collect())
    assert star([(3, 1), (4, 1), (9, 8)]) == [] and star([(3, 1), (3, 2)]) == [3] and star([(3, 2), (2, 1)]) == [2]


@pytest.mark.parametrize("sent", [0, 50])
def test_more_than_are_sent(spark, monkeypatch, sent):
    monkeypatch.setattr(common, "SENT", sent)
    rng = random.Random(8)
    words, passage = [f"w{k}" for k in range(60)], [f"p{k}" for k in range(60)]
    rows = [(k, changed(rng, words, 1 + k % 2) if k % 3 else " ".join(words)) for k in range(90)]
    rows += [(1000 + k, " ".join(passage + [f"q{k % 40}.{j}" for j in range(20 + k % 7)])) for k in range(80)]
    check(spark, rows)
    test_components(spark)


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, op3_ngram_join(spark, sf).collect()), key=repr) == brute(docs)


@pytest.mark.parametrize("seed", range(3))
def test_similar_sets_share_a_signature(seed):
    rng = np.random.default_rng(seed)
    for _ in range(400):
        s = np.unique(rng.integers(0, 2**64, int(rng.integers(1, 300)), dtype=np.uint64))
        kept = rng.permutation(s)[: len(s) - int(rng.integers(0, len(s) // 5 + 1))]
        add = max(0, int(len(kept) / 0.8) - len(s))
        other = np.unique(np.concatenate((kept, rng.integers(0, 2**64, add, dtype=np.uint64))))
        both = len(np.intersect1d(s, other))
        if 100 * both >= 80 * (len(s) + len(other) - both):
            assert len(np.intersect1d(ngram_join.signatures(s), ngram_join.signatures(other)))


def test_hashes_do_not_depend_on_the_batch():
    texts = ["", None, "  a bb  ccc\n", "x" * 9000 + " y", "a bb"]
    alone = [hashing.word_hashes([t])[0].tolist() for t in texts]
    hashes, begins = hashing.word_hashes(texts)
    assert [hashes[a:b].tolist() for a, b in zip(begins, begins[1:])] == alone
    assert alone[2][:2] == alone[4] and [len(a) for a in alone] == [0, 0, 3, 2, 2]


def test_components(spark):
    rng = random.Random(6)
    chain = [(k, k + 1) for k in range(100, 160)]
    star = [(1, k) for k in range(2, 40)]
    loose = [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    edges = chain + star + loose + [(7, 7), (500, 500)]
    up = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: up[x] for x in linked}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
