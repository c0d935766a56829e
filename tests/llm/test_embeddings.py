"""Lattice hashing: the decoder, recall against brute force, and edges."""

import numpy as np

from factlog.llm import embeddings
from factlog.llm.queries import op4_embeddings


def brute(rows, threshold=0.93):
    """(id, n_links, component) of rows id, vector, label."""
    ok = [v is not None and lab is not None and i is not None and None not in v and np.isfinite(v).all() and np.any(v) for i, v, lab in rows]
    up = list(range(len(rows)))
    links = [0] * len(rows)

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold:
                    links[a] += 1
                    links[b] += 1
                    up[root(a)] = root(b)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted(((i, links[k], least.get(root(k), i)) for k, (i, _, _) in enumerate(rows)), key=repr)


def check(spark, rows):
    df = spark.createDataFrame([(i, v, lab, 1) for i, v, lab in rows], "vec_id long, embedding array<double>, label int, node int")
    assert sorted(map(tuple, embeddings.near_duplicates(df).collect()), key=repr) == brute(rows)


def test_decoder_finds_the_nearest_point():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 8)) * 2
    got = embeddings.nearest_e8(x)
    near = np.concatenate((got[:, None], got[:, None] + embeddings.MINIMAL), axis=1)
    assert (((x[:, None] - near) ** 2).sum(axis=2).argmin(axis=1) == 0).all()
    doubled = (got * 2).astype(int)
    assert ((doubled % 2 == doubled[:, :1] % 2).all(axis=1)).all() and (got.sum(axis=1) % 2 == 0).all()
    assert len(embeddings.MINIMAL) == 240 and np.allclose((embeddings.MINIMAL**2).sum(axis=1), 2)


def test_recall_at_the_threshold():
    rng = np.random.default_rng(2)
    x, r = rng.normal(size=(2, 2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    r -= (r * x).sum(axis=1, keepdims=True) * x
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * r / np.linalg.norm(r, axis=1, keepdims=True)
    met = np.zeros(2000, bool)
    for t in range(embeddings.TABLES):
        a, b = embeddings.cells(x, t), embeddings.cells(y, t)
        met |= (a == b[:, :1]).any(axis=1) | (b == a[:, :1]).any(axis=1)
    assert met.mean() >= 0.99


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    v, big = [1.0] + [0.1] * 15, [1e300, 1e299] + [0.0] * 14
    rows = [(1, v, 0), (2, v, 0), (3, [2 * x for x in v], 0), (4, v, 1), (5, v, None), (6, None, 0), (7, [0.0] * 16, 0), (8, [nan] + v[1:], 0), (9, [inf] + v[1:], 0), (10, [None] + v[1:], 0), (11, [], 0), (12, v[:8], 0), (None, v, 0), (1, v, 0), (13, [-x for x in v], 0), (14, big, 3), (15, [x / 1e300 for x in big], 3), (1, [-x for x in v], 1)]
    check(spark, rows)
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_groups_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 32))
    check(spark, [(k, (centres[k % 6] + 0.05 * rng.normal(size=32)).tolist(), k % 2) for k in range(240)])


def test_large_groups_leave_ties_only(spark):
    """Every vector of a large group is counted once with every other, though no pair leaves its task."""
    rng = np.random.default_rng(4)
    centre = rng.normal(size=24)
    rows = [(k, (centre + 0.04 * rng.normal(size=24)).tolist(), 0) for k in range(400)] + [(1000 + k, rng.normal(size=24).tolist(), 0) for k in range(50)]
    check(spark, rows)
    nodes = spark.createDataFrame([(k, lab, v, 1) for k, v, lab in rows], "node long, label int, vec array<double>, copies long")
    out = embeddings.links(nodes).collect()
    assert sum(r.others for r in out) == sum(n for _, n, _ in brute(rows)) and len(out) < 54 * 2 * len(rows)


def test_query(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in op4_embeddings(spark, sf).collect()), key=repr) == brute(rows)
