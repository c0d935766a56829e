"""Embedding near-duplicates by lattice hashing.

Vectors are scaled to length 1, projected at random onto 8 dimensions and decoded to the nearest point of the lattice E8,
in several tables. Each vector lies in its own cell and also probes the neighbouring cells nearest to it; vectors of one
label that meet in a cell are compared by cosine in double precision. Equal vectors are one node from the start, so that a
cell holds different vectors only; a cell with many is compared in blocks. Linked pairs never leave their task: what leaves it is, for
each vector, a tie to the least vector of its links there, and how many links it has. A pair that meets in several cells is counted in the
first table where it meets only, in the cell of the one with the smaller number if the other came there, else in the other's; both follow from the vectors.

Comparisons within a label grow with the square of its rows over the number of cells that these fill; the lattice's scale is fixed, as recall at the threshold depends on it.

Defined results: null, zero, and non-finite vectors, vectors with null components and those without a label link with
nothing; vectors of different lengths aren't compared; rows that repeat an id count as vectors of that id;
an empty table gives an empty result; columns besides id, vector and label are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeing, spread_join, stored
from .graph import components

COSINE = 0.93
TABLES, PROBES, SCALE = 6, 8, 1.2
BLOCK = 1024


def _minimal() -> np.ndarray:
    """The 240 shortest vectors of E8: (+-1, +-1, 0, ...) in all places, and (+-1/2, ...) with an even number of minus signs."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (-1, 1):
                for b in (-1, 1):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for bits in range(256):
        signs = np.array([1 - 2 * (bits >> k & 1) for k in range(8)])
        if np.prod(signs) == 1:
            out.append(signs / 2)
    return np.array(out)


MINIMAL = _minimal()


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest points of integers with an even sum: round, and where the sum is odd round the worst coordinate the other way."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(axis=1) % 2)
    err = x[odd] - r[odd]
    worst = np.abs(err).argmax(axis=1)
    r[odd, worst] += np.where(err[np.arange(len(odd)), worst] >= 0, 1, -1)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8, the union of D8 and D8 shifted by one half in every coordinate."""
    a, b = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    nearer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(nearer[:, None], a, b)


def projection(table: int, dims: int, seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng((seed, table, dims))
    return rng.standard_normal((dims, 8)) / SCALE, rng.uniform(-1, 1, 8)


def cells(unit: np.ndarray, table: int, probes: int = PROBES) -> np.ndarray:
    """Hashes of each vector's cell and of the probes cells next to it, nearest first: one row a vector."""
    matrix, shift = projection(table, unit.shape[1])
    y = np.einsum("ij,jk->ik", unit, matrix) + shift  # the same for a vector in any company
    home = nearest_e8(y)
    # of the neighbours, those whose centre is nearest: the largest product of the offset with the step
    order = np.argsort(-np.einsum("ij,kj->ik", y - home, MINIMAL), axis=1, kind="stable")[:, :probes]
    points = np.concatenate((home[:, None], home[:, None] + MINIMAL[order]), axis=1)
    key = (points * 2).astype(np.int64).astype(np.uint64)
    factors = np.random.default_rng((99, table)).integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    h = (key * factors).sum(axis=2, dtype=np.uint64)
    return (h ^ (h >> np.uint64(31))).view(np.int64)


def unit_rows(column: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in column])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _placed(tables: int, probes: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            for _, same in df.groupby(df["vec"].map(len)):
                unit = unit_rows(same["vec"])
                for t in range(tables):
                    keys = cells(unit, t, probes)
                    width = keys.shape[1]
                    yield pd.DataFrame({"label": np.repeat(same["label"].to_numpy(), width), "dims": unit.shape[1], "t": t, "cell": keys.ravel(), "node": np.repeat(same["node"].to_numpy(), width), "home": np.tile(np.arange(width) == 0, len(same))})

    return run


def tied(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """For each of n places the least place that links of x with y reach."""
    least = np.arange(n)
    while True:
        low = np.minimum(least[x], least[y])
        after = least.copy()
        np.minimum.at(after, x, low)
        np.minimum.at(after, y, low)
        after = after[after]
        if (after == least).all():
            return least
        least = after


def _verified(threshold: float, tables: int, probes: int):
    """Ties (a, b, 0) and numbers of links (a, a, others) of rows that come sorted by cell and pair of blocks: those at home there with all that came."""

    def counted(df: pd.DataFrame, unit: np.ndarray, first: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which of the linked pairs, x with the smaller node, count here. first: of each row, the first row with its node."""
        rows, place = np.unique(np.concatenate((first[x], first[y])), return_inverse=True)
        a, b = place[: len(x)], place[len(x) :]
        t, cell, i, j, block = (df[c].to_numpy() for c in ("t", "cell", "i", "j", "block"))
        out, open_ = np.zeros(len(x), bool), np.ones(len(x), bool)
        for table in range(tables):
            keys = cells(unit[rows], table, probes)
            home = keys[:, 0]
            at_a, at_b = (home[a][:, None] == keys[b]).any(axis=1), (home[b][:, None] == keys[a]).any(axis=1)
            owner, other = np.where(at_a, x, y), np.where(at_a, y, x)
            here = open_ & (at_a | at_b) & (t[x] == table) & (np.where(at_a, home[a], home[b]) == cell[x])
            out |= here & (block[owner] == i[x]) & (block[other] == j[x])
            open_ &= ~(at_a | at_b)
        return out

    def linked(df: pd.DataFrame, group: np.ndarray) -> pd.DataFrame:
        home, block, i, j, node, copies = (df[c].to_numpy() for c in ("home", "block", "i", "j", "node", "copies"))
        unit = unit_rows(df["vec"])
        end = np.searchsorted(group, group, "right")
        at, found, step = np.arange(len(df)), [np.empty((2, 0), np.int64)], 1
        while len(at := at[at + step < end[at]]):  # each row with the one that stands so many places on
            x, y = at, at + step
            # one is at home in block i, the other came from block j
            meet = (home[x] & (block[x] == i[x]) & (block[y] == j[x])) | (home[y] & (block[y] == i[x]) & (block[x] == j[x]))
            meet &= node[x] != node[y]
            x, y = x[meet], y[meet]
            ok = np.einsum("ij,ij->i", unit[x], unit[y]) >= threshold
            found.append(np.stack((x[ok], y[ok])))
            step += 1
        x, y = np.concatenate(found, axis=1)
        x, y = np.where(node[x] < node[y], x, y), np.where(node[x] < node[y], y, x)
        names, begins, at = np.unique(node, return_index=True, return_inverse=True)
        least = tied(at[x], at[y], len(names))
        ties = np.flatnonzero(least != np.arange(len(names)))
        others = np.zeros(len(names), np.int64)
        for part in np.array_split(np.arange(len(x)), len(x) // 100_000 + 1):
            here = part[counted(df, unit, begins[at], x[part], y[part])] if len(part) else part
            np.add.at(others, at[x[here]], copies[y[here]])
            np.add.at(others, at[y[here]], copies[x[here]])
        some = np.flatnonzero(others)
        return pd.DataFrame({"a": np.concatenate((names[ties], names[some])), "b": np.concatenate((names[least[ties]], names[some])), "others": np.concatenate((np.zeros(len(ties), np.int64), others[some]))})

    def of_one_size(df: pd.DataFrame, group: np.ndarray) -> Iterator[pd.DataFrame]:
        dims = df["dims"].to_numpy()
        for size in np.unique(dims):
            yield linked(df[dims == size].reset_index(drop=True), group[dims == size])

    @freeing
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = None
        for df in parts:
            df = df if left is None else pd.concat((left, df), ignore_index=True)
            new = np.flatnonzero((df[GROUP].ne(df[GROUP].shift())).any(axis=1).to_numpy())
            cut = int(new[-1])  # the last group may go on
            left = df.iloc[cut:]
            if cut:
                yield from of_one_size(df.iloc[:cut], np.searchsorted(new, np.arange(cut), "right"))
        if left is not None and len(left):
            yield from of_one_size(left, np.zeros(len(left), np.int64))

    return run


#: What a bucket of the comparison is: a cell of one table and label, and two of its blocks.
CELL = ["label", "dims", "t", "cell"]
GROUP = [*CELL, "i", "j"]


def links(nodes: DataFrame, threshold: float = COSINE, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """a, b, others: ties between linked nodes (others 0), and parts of the number of vectors that a is linked with (b = a). nodes: node, label, vec, copies."""
    placed = nodes.mapInPandas(_placed(tables, probes), f"label {nodes.schema['label'].dataType.simpleString()}, dims int, t int, cell long, node long, home boolean")
    placed = stored(placed, "lattice-cells")
    # only cells with someone at home and another vector matter
    size = placed.groupBy(*CELL).agg(F.count(F.lit(1)).alias("m"), F.max("home").alias("lived")).filter("m > 1 and lived")
    rows = placed.join(size.drop("lived"), CELL).withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    # a row stands in block pairs (i, j): as i where it is at home, as j for every i
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    as_home = F.when(F.col("home"), F.transform(every, lambda j: F.struct(F.col("block").alias("i"), j.alias("j")))).otherwise(F.array().cast("array<struct<i:int,j:int>>"))
    as_other = F.transform(every, lambda i: F.struct(i.alias("i"), F.col("block").alias("j")))
    rows = rows.withColumn("p", F.explode(F.array_union(as_home, as_other))).select(*CELL, "node", "home", "block", "p.i", "p.j")
    rows = rows.join(nodes.select("node", "vec", "copies"), "node").repartition(*GROUP).sortWithinPartitions(*GROUP)
    return rows.mapInPandas(_verified(threshold, tables, probes), "a long, b long, others long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", **options) -> DataFrame:
    """id, n_links (other vectors linked directly, copies included), component (smallest id reachable by links) of every row."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vec"), F.col(label_col).alias("label"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    valid = F.col("vec").isNotNull() & F.col("label").isNotNull() & F.col("id").isNotNull() & ~F.exists("vec", bad) & F.exists("vec", lambda x: x != 0)
    good = rows.filter(F.coalesce(valid, F.lit(False)))
    nodes = stored(good.groupBy("label", "vec").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies")), "vectors")
    # rows of one id with different vectors are different nodes: a number of their own names them
    nodes = stored(nodes.withColumn("first", F.col("node")).withColumn("node", F.xxhash64("label", "vec")), "vectors")
    found = stored(links(nodes.select("node", "label", "vec", "copies"), **options), "vector-links")
    degree = found.groupBy(F.col("a").alias("node")).agg(F.sum("others").alias("others"))
    labels = nodes.select("node", "first", "copies").join(components(found.select("a", "b")), "node", "left").withColumn("component", F.coalesce("component", "node"))
    labels = stored(labels, "vector-labels")
    least = labels.groupBy("component").agg(F.min("first").alias("least"))
    labels = spread_join(labels, least, "component").join(degree, "node", "left")
    facts = labels.select(F.col("node").alias("_node"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "least")
    keyed = rows.withColumn("_key", F.when(F.coalesce(valid, F.lit(False)), F.xxhash64("label", "vec"))).select("id", "_key")
    out = spread_join(keyed, facts.withColumnRenamed("_node", "_key"), "_key", "left")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("least", "id").alias("component"))
