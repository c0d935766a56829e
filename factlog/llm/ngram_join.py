"""N-gram Jaccard self-join with PartEnum signatures: exact, for similarity 0.8 of sets of five-word shingles.

Sets are grouped into bands of size. Two sets of which the larger has at most r elements and which are similar differ in
k = 2 r / 9 elements at most. The domain of shingles is divided into more than k partitions; the sets agree on one at
least, and what a set holds in one partition is a signature. A set emits signatures for its own band and for that of
the largest set it can be similar to, so similar sets of neighbouring bands meet as well. Small sets use the second level: the domain is divided into k + c parts and a signature is what a set holds in c of them, for every choice of c.

Signatures of one or two shingles, such as a passage that many documents share leaves behind, would put unrelated sets
together. The domain is therefore divided into spare partitions more than the k + 1 that are needed. Similar sets then agree on
spare + 1 of them. Partitions are ranked by how many elements a set holds in them, then by a hash of these: by content alone, so the
partitions on which two sets agree have one order in both. Each set leaves out its spare last ones; of those on which the two agree the
first is not among them in either. So k + 1 signatures are emitted, the fullest, and nothing is lost.

Equal sets are one node from the start. Every bucket of sets that share a signature has two leaders, its least and its
greatest node, with which all others are compared: each set first with the one leader with which it shares most signatures, with others
only if they lie in different components then. What remains are sets of one bucket that are no leaders and lie in different components.
In each bucket those of the largest component are compared with the others, and the others with each other, in blocks. Before sets are
fetched, sizes and lower bounds of the distance (sketches) rule pairs out. A pair that meets in many buckets belongs to the first of them: rows carry
the first signatures of their sets, and where two sets have an earlier one in common the pair is left to that bucket. Of the pairs that remain each set first names the one that looks nearest;
these are verified and components grow together; only sets that still have such pairs go on, with more of them in each round and all in the last. So a bucket of thousands of near copies verifies thousands of
pairs, not millions, and no link between components is lost. Every comparison that counts is exact on the sets of 64-bit shingle hashes.

Signatures that many documents of a sample hold are dealt out in SALTS parts with leaders of their own; the sample decides only
where rows go. Joins on other keys that may repeat often (a leader, a component, a node with many copies) are salted likewise.
Tables of few short rows (common.SENT) are sent to every task instead: in late rounds shuffles of almost nothing would take longest.

Defined results: a null or empty text has no shingles and is linked with nothing; fewer than five words are one
shingle; repeated rows are equal sets; the component of a document is the smallest id it reaches (ids that are null don't
count, unless all are null); ids are whole numbers, as numbers or as text; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dealt, few, freeing, hot_keys, looked_up, repeated, salted_join, stored
from .graph import components
from .hashing import U, mixed, shingle_sets

#: Bands end at these sizes times GROWTH, and so on; up to SMALL the second level is used, with CHOSEN parts in a signature.
GROWTH, SMALL, CHOSEN = 1.4, 30, 2
#: Partitions for each that is needed.
SPARE = 1.3
#: A sketch has about as many bits as its set elements, a power of two between these.
FEWEST_BITS, MOST_BITS = 256, 16384
#: Ids, of 16 bytes, that are sent to every task instead of moving the texts to them.
FEW = 1_000_000
#: Bytes that one task may make of one node's value, by repeating it for each of its pairs.
REPEATED = 256 << 20
BLOCK = 2048
#: A signature is dealt out in SALTS parts when more than this share of the sampled documents hold it; so there are at most
#: 1 / HOT_SHARE times as many as a document has signatures.
HOT_SHARE, SAMPLED, SALTS = 1 / 1000, 64, 64


@lru_cache(maxsize=None)
def band_end(band: int) -> int:
    end = 3
    for _ in range(band):
        end = max(end + 1, int(end * GROWTH))
    return end


def band_of(size: int) -> int:
    band = 0
    while band_end(band) < size:
        band += 1
    return band


@lru_cache(maxsize=None)
def plan(band: int) -> tuple[int, int, tuple[tuple[int, ...], ...]]:
    """Partitions, how many of them a set leaves out, and for small sets the choices of parts that make a signature."""
    r = band_end(band)
    k = 2 * r // 9
    if k == 0:
        return 1, 0, ((0,),)
    if r <= SMALL:
        return k + CHOSEN, 0, tuple(combinations(range(k + CHOSEN), CHOSEN))
    least = max(1, int(0.8 * (band_end(band - 1) + 1)))
    n = round(SPARE * (k + 1))
    while n < 2 * (k + 1) and n - k - 1 < (empty := n * (1 - 1 / n) ** least) + 3 * sqrt(empty):
        n += 1  # empty partitions, which say nothing, should be left out
    return n, n - k - 1, ()


def signatures(s: np.ndarray) -> np.ndarray:
    """The signatures of a sorted set of shingle hashes."""
    size = len(s)
    if not size:
        return np.empty(0, np.uint64)
    out = []
    content = mixed(s ^ U(0x5851F42D4C957F2D))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(content, dtype=np.uint64)))
    for band in range(band_of(size), band_of(size * 5 // 4) + 1):
        n, spare, choices = plan(band)
        part = ((s >> U(32)) * U(n)) >> U(32)  # rises with s
        edges = np.searchsorted(part, np.arange(n + 1, dtype=np.uint64))
        held = sums[edges[1:]] - sums[edges[:-1]]
        salt = U((band + 1) * 0x2545F4914F6CDD1D % 2**64)
        if choices:
            held = np.array([mixed(held[list(c)] + np.array(c, np.uint64)).sum(dtype=np.uint64) for c in choices], np.uint64)
            out.append(mixed(mixed(held + salt) + np.arange(len(choices), dtype=np.uint64)))
        else:
            named = mixed(mixed(held + salt) + np.arange(n, dtype=np.uint64))
            rank = (np.minimum(edges[1:] - edges[:-1], 255).astype(np.uint64) << U(56)) | (named >> U(8))
            out.append(named[np.argpartition(rank, spare)[spare:]] if spare else named)
    return np.concatenate(out)


def node_of(s: np.ndarray) -> int:
    """One number for a set: equal sets are one node. -1 for the empty set."""
    return int(mixed(mixed(s).sum(dtype=np.uint64, keepdims=True) + U(len(s))).view(np.int64)[0]) if len(s) else -1


def sketch_of(s: np.ndarray) -> bytes:
    """Whether the number of elements in each of its bins is odd: two sets differ in as many elements at least as their bits."""
    bits = min(max(FEWEST_BITS, 1 << max(len(s) - 1, 0).bit_length()), MOST_BITS)
    return np.packbits(np.bincount((mixed(s) % U(bits)).astype(np.int64), minlength=bits) & 1).tobytes()


class Sketches:
    """A column of sketches, compared at the length of the shorter one: halves of a sketch add up to that of half the length."""

    def __init__(self, column: pd.Series):
        values = column.tolist()
        self.length = np.fromiter(map(len, values), np.int64, len(values))
        self.place, self.rows = np.zeros(len(values), np.int64), {}
        for size in np.unique(self.length).tolist():
            mine = np.flatnonzero(self.length == size)
            self.place[mine] = np.arange(len(mine))
            self.rows[size] = np.frombuffer(b"".join([values[k] for k in mine]), np.uint64).reshape(len(mine), size // 8)

    def _at(self, x: np.ndarray, length: int) -> np.ndarray:
        out = np.empty((len(x), length // 8), np.uint64)
        own = self.length[x]
        for size in np.unique(own).tolist():
            bits = self.rows[size][self.place[x[own == size]]]
            while bits.shape[1] > length // 8:
                half = bits.shape[1] // 2
                bits = bits[:, :half] ^ bits[:, half:]
            out[own == size] = bits
        return out

    def far(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """In how many elements at least the sets x differ from the sets y beside them."""
        out = np.zeros(len(x), np.int64)
        length = np.minimum(self.length[x], self.length[y])
        for size in np.unique(length).tolist():
            mine = np.flatnonzero(length == size)
            for part in np.array_split(mine, len(mine) * size // 8_000_000 + 1):
                out[part] = np.bitwise_count(self._at(x[part], size) ^ self._at(y[part], size)).sum(axis=1, dtype=np.int64)
        return out


@freeing
def _nodes(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in parts:
        rows = [(len(s), node_of(s), sketch_of(s)) for s in shingle_sets(df["text"].tolist())]
        yield pd.DataFrame({"id": df["id"], "key": df["key"], "n": [r[0] for r in rows], "node": [r[1] for r in rows], "sketch": [r[2] for r in rows]})


@freeing
def _signed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: set[int] = set()  # copies in one partition sign once
    for df in parts:
        rows: list[tuple] = []
        for s in shingle_sets(df["text"].tolist()):
            if len(s) and (node := node_of(s)) not in seen:
                seen.add(node)
                rows.append((node, signatures(s).view(np.int64)))
                if len(rows) >= 256:
                    yield pd.DataFrame(rows, columns=["node", "signs"])
                    rows = []
        if rows:
            yield pd.DataFrame(rows, columns=["node", "signs"])


def signed(rows: DataFrame) -> DataFrame:
    """node, sign of all signatures of rows with a text."""
    return rows.select("text").mapInPandas(_signed, "node long, signs array<long>").select("node", F.explode("signs").alias("sign"))


@freeing
def _sets(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in parts:
        for a in range(0, len(df), 256):
            sets = list(shingle_sets(df["text"].iloc[a : a + 256].tolist()))
            mine = [k for k, (s, node) in enumerate(zip(sets, df["node"].iloc[a : a + 256])) if node_of(s) == node]  # ids may repeat
            if mine:
                yield pd.DataFrame({"node": df["node"].iloc[a : a + 256].iloc[mine], "members": [sets[k].view(np.int64) for k in mine]})


def _sides(pairs: DataFrame, values: DataFrame, length: Column, once: bool) -> DataFrame:
    """The pairs, a table that is written, beside x and y, what values have for the nodes a and b. values: node and more; length: of a value, in bytes; once: no node repeats.

    Few pairs are sent to all tasks, which deal out the values that they hold by pair; else, or where one node's value would be
    repeated too often in one task, hot nodes are dealt out.
    """
    own = F.struct(*[c for c in values.columns if c != "node"])
    if few(pairs):
        end = lambda node, is_a: F.struct(F.col(node).alias("node"), F.lit(is_a).alias("is_a"))
        ends = pairs.select(*pairs.columns, F.explode(F.array(end("a", True), end("b", False))).alias("e")).select(*pairs.columns, "e.node", "e.is_a")
        often = ends.groupBy("node").agg(F.count(F.lit(1)).alias("_c"))
        if (values.join(F.broadcast(often), "node").agg(F.max(F.col("_c") * length)).first()[0] or 0) <= REPEATED:
            each = values.select("node", own.alias("_v")).join(F.broadcast(ends), "node")
            side = lambda is_a, name: F.any_value(F.when(F.col("is_a") == is_a, F.col("_v")), True).alias(name)
            return each.groupBy(*pairs.columns).agg(side(True, "x"), side(False, "y")).filter("x is not null and y is not null")
    hot = stored(hot_keys(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), "node"), "hot-nodes")
    held = repeated((values if once else values.dropDuplicates(["node"])).select("node", own.alias("_v")), hot, "node")  # one shuffle serves both sides
    left = dealt(pairs, hot, "a", ["a", "b"]).join(held.select(F.col("node").alias("a"), "_salt", F.col("_v").alias("x")), ["a", "_salt"]).drop("_salt")
    return dealt(left, hot, "b", ["a", "b"]).join(held.select(F.col("node").alias("b"), "_salt", F.col("_v").alias("y")), ["b", "_salt"]).drop("_salt")


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs a, b whose sets have a Jaccard similarity of 0.8 or more."""
    both = _sides(pairs, sets, 8 * F.size("members"), False).withColumn("common", F.size(F.array_intersect("x.members", "y.members")))
    return both.filter(100 * F.col("common") >= 80 * (F.size("x.members") + F.size("y.members") - F.col("common"))).select("a", "b")


def _close(n: np.ndarray, sketches: Sketches, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the rows x may be similar to the rows y beside them, by sizes and sketches, and how much room these leave, 0 to 1."""
    some = np.flatnonzero(5 * np.minimum(n[x], n[y]) >= 4 * np.maximum(n[x], n[y]))
    room = 1 - 9 * sketches.far(x[some], y[some]) / (n[x[some]] + n[y[some]])
    return some[room >= 0], room[room >= 0]


@freeing
def _plausible(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in parts:
        n = np.concatenate((df["na"], df["nb"]))
        ok, _ = _close(n, Sketches(pd.concat((df["sa"], df["sb"]))), np.arange(len(df)), np.arange(len(df)) + len(df))
        yield df[["a", "b", "c"]].iloc[ok]


def plausible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of the pairs a, b, c (in how many buckets they meet) that sizes and sketches don't rule out."""
    both = _sides(pairs, nodes.select("node", "n", "sketch"), F.length("sketch"), True)
    both = both.select("a", "b", "c", F.col("x.n").alias("na"), F.col("y.n").alias("nb"), F.col("x.sketch").alias("sa"), F.col("y.sketch").alias("sb"))
    return both.mapInPandas(_plausible, "a long, b long, c long")


#: Groups of more rows are compared row by row, smaller ones of a batch together.
VECTORED = 1024


#: With so many of its first signatures a set shows in which buckets a pair was named already. Pairs that sketches allow agree on about a third of all.
FIRSTS = 32
#: How many pairs a set names in each round of _rest(); 0: all.
ROUNDS = (1, 16, 256, 0)


def _near(most: int):
    """Pairs in different components of rows that come sorted by (sign, i, j): a bucket, or two blocks of one."""

    @freeing
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = None
        for df in parts:
            df = df if left is None else pd.concat((left, df), ignore_index=True)
            keys = df[["sign", "i", "j"]].to_numpy()
            new = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1))
            cut = int(new[-1]) + 1 if len(new) else 0  # the last bucket may go on
            left = df.iloc[cut:]
            yield from _nearest(df.iloc[:cut], most)
        if left is not None:
            yield from _nearest(left, most)

    return run


def _nearest(df: pd.DataFrame, most: int) -> Iterator[pd.DataFrame]:
    """The pairs of these groups, of which every node names so many with the most room."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for found in _pairs(df):
        held.append(found)
        if sum(len(h[0]) for h in held) > 500_000:
            held = [_named(held, most)]
            if not most:
                yield pd.DataFrame({"a": held[0][0], "b": held[0][1]})
                held = []
    if held:
        a, b, _ = _named(held, most)
        yield pd.DataFrame({"a": a, "b": b})


def _named(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, b, room = (np.concatenate(c) for c in zip(*held))
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a))
    a, b, room = a[order], b[order], room[order]
    once = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))[: len(a)]
    a, b, room = a[once], b[once], room[once]
    if not most:
        return a, b, room
    node, pair = np.concatenate((a, b)), np.tile(np.arange(len(a)), 2)
    order = np.lexsort((pair, -room[pair], node))
    first = np.flatnonzero(np.concatenate(([True], node[order][1:] != node[order][:-1]))[: len(order)])
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    kept = np.unique(pair[order][rank < most])
    return a[kept], b[kept], room[kept]


def _firsts(column: pd.Series) -> np.ndarray:
    """A row of FIRSTS signatures for each list, filled up with what is before no signature."""
    lists = column.tolist()
    length = np.fromiter(map(len, lists), np.int64, len(lists))
    out = np.full((len(lists), FIRSTS), np.iinfo(np.int64).max)
    out[np.arange(FIRSTS) < length[:, None]] = np.concatenate(lists)
    return out


def _met(sign: np.ndarray, firsts: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the rows x, of these signatures, and the rows y beside them are seen to have an earlier signature in common."""
    out = np.zeros(len(x), bool)
    for part in np.array_split(np.arange(len(x)), len(x) * FIRSTS // 4_000_000 + 1):
        both = np.sort(np.concatenate((firsts[x[part]], firsts[y[part]]), axis=1), axis=1)
        out[part] = ((both[:, 1:] == both[:, :-1]) & (both[:, 1:] < sign[x[part], None])).any(axis=1)
    return out


def _pairs(df: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Nodes of plausible pairs in different components that meet here first, and the room of each."""
    if df.empty:
        return
    df = df.sort_values(["sign", "i", "j", "n"], kind="stable")
    n, sketches, node, component, block = df["n"].to_numpy(), Sketches(df["sketch"]), df["node"].to_numpy(), df["component"].to_numpy(), df["block"].to_numpy()
    keys, firsts = df[["sign", "i", "j"]].to_numpy(), _firsts(df["firsts"])
    within = keys[:, 1] == keys[:, 2]  # one block; of two, rows are compared with those of the other only
    begins = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1))))
    ends = np.append(begins[1:], len(df))
    end = np.repeat(ends, ends - begins)
    large = np.repeat(ends - begins > VECTORED, ends - begins)

    def kept(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        differ = (component[x] != component[y]) & (within[x] | (block[x] != block[y]))
        x, y = x[differ], y[differ]
        ok, room = _close(n, sketches, x, y)
        here = ~_met(keys[:, 0], firsts, x[ok], y[ok])
        return node[x[ok[here]]], node[y[ok[here]]], room[here]

    at, step = np.flatnonzero(~large), 1
    while len(at := at[at + step < end[at]]):  # each row with the one that stands so many places on; sizes rise
        at = at[4 * n[at + step] <= 5 * n[at]]
        yield kept(at, at + step)
        step += 1
    for a, b in zip(begins.tolist(), ends.tolist()):
        if b - a > VECTORED:
            last = a + np.searchsorted(n[a:b], n[a:b] * 5 // 4, "right")
            for x in range(a, b - 1):
                y = np.arange(x + 1, last[x - a])
                if len(y):
                    yield kept(np.full(len(y), x), y)


def _members(shared: DataFrame) -> DataFrame:
    """sign, hot, node: rows of buckets in which leaders have not met all others."""
    return shared.filter("hot or (m > 3 and node != lo and node != hi)").select("sign", "hot", "node")


def _faces(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, n, sketch, firsts of all nodes in rows of buckets; later rounds have all rows of a node or none, so these hold for them too."""
    firsts = rows.groupBy("node").agg(F.slice(F.array_sort(F.collect_set("sign")), 1, FIRSTS).alias("firsts"))
    return stored(nodes.select("node", "n", "sketch").join(firsts, "node"), "faces")


def _rest(rows: DataFrame, faces: DataFrame, found: DataFrame, most: int) -> DataFrame | None:
    """Pairs that share a signature but no leader, lie in different components so far, and that sizes and sketches don't rule out; None if no bucket has two components.

    In a cold bucket leaders have met all others. Rows of a bucket's largest component go in chunks to every block of the other rows;
    these go to every pair of blocks that holds their own. Both in one group where one block and one chunk hold all.
    """
    rows = looked_up(rows, found, "node", "left")
    rows = stored(rows.withColumn("component", F.coalesce("component", "node")), "bucket-rows")
    sizes = rows.groupBy("sign", "hot", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("sign", "hot")
    open_ = sizes.agg(F.max(F.struct("c", "component")).alias("most"), F.sum("c").alias("m")).filter("m > most.c")
    open_ = stored(open_.select(F.col("sign").alias("_s"), "hot", "most", (F.col("m") - F.col("most.c")).alias("others")), "open-buckets")
    if open_.isEmpty():
        return None
    at = F.col("sign") == F.col("_s")
    if few(open_):
        rows = rows.join(F.broadcast(open_.drop("hot")), at)
    else:
        cold = rows.filter("not hot").join(open_.filter("not hot").drop("hot"), at)
        rows = cold.unionByName(rows.filter("hot").join(F.broadcast(open_.filter("hot").drop("hot")), at))  # as many as there are hot signatures
    rows = rows.withColumn("major", F.col("component") == F.col("most.component"))
    rows = rows.withColumn("blocks", F.ceil(F.col("others") / BLOCK).cast("int")).withColumn("chunks", F.ceil(F.col("most.c") / (8 * BLOCK)).cast("int"))
    mine = F.xxhash64("node")
    rows = rows.withColumn("block", F.when(F.col("major"), -1).otherwise(F.pmod(mine, "blocks").cast("int"))).withColumn("chunk", F.pmod(mine, "chunks").cast("int"))
    every = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    group = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    as_major = F.transform(every("blocks"), lambda b: group(b, -1 - F.col("chunk")))
    as_other = F.concat(
        F.transform(every("blocks"), lambda b: group(F.least(b, F.col("block")), F.greatest(b, F.col("block")))),
        F.transform(every("chunks"), lambda c: group(F.col("block"), -1 - c)),
    )
    one = (F.col("blocks") == 1) & (F.col("chunks") == 1)
    groups = F.when(one, F.array(group(F.lit(0), F.lit(0)))).when(F.col("major"), as_major).otherwise(as_other)
    rows = rows.select("sign", "node", "component", "block", F.explode(groups).alias("g")).select("sign", "node", "component", "block", "g.i", "g.j")
    rows = rows.join(faces, "node")
    rows = rows.repartition("sign", "i", "j").sortWithinPartitions("sign", "i", "j")
    return stored(rows.mapInPandas(_near(most), "a long, b long").distinct(), "candidates")


def _links(pairs: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Those of the pairs, a table that is written, that are similar. Sets are made from one document of each node."""
    if pairs.isEmpty():
        return pairs
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
    wanted = nodes.select("node", "first").join(F.broadcast(ends), "node", "left_semi") if few(pairs) else ends.distinct().join(nodes.select("node", "first"), "node")
    wanted = stored(wanted.select(F.col("first").alias("id"), "node"), "candidate-nodes")
    sent = wanted.count() <= FEW
    wanted = wanted.withColumnRenamed("id", "_id")
    texts = rows.join(F.broadcast(wanted) if sent else wanted, F.col("id").eqNullSafe(F.col("_id")))
    return similar(pairs, stored(texts.select("node", "text").mapInPandas(_sets, "node long, members array<long>"), "candidate-sets", "none"))


def text_key(text: str) -> Column:
    """A hash that tells apart the texts of one id."""
    return F.xxhash64(F.col(text).cast("string"))


def _copies(each: DataFrame, nodes: DataFrame) -> DataFrame | None:
    """_id, _key of rows whose set another document stands for; None where they are many."""
    more = nodes.filter("rows > 1")
    if (more.agg(F.sum(F.col("rows") - 1)).first()[0] or 0) > FEW:
        return None
    owners = more.select("node", F.col("first").alias("_first"), F.col("key").alias("_of"))
    held = each.filter("n > 0").select("id", "key", "node")
    held = held.join(F.broadcast(owners), "node") if few(owners) else salted_join(held, owners, "node")
    return held.filter(~(F.col("id").eqNullSafe(F.col("_first")) & (F.col("key") == F.col("_of")))).select(F.col("id").alias("_id"), F.col("key").alias("_key"))


def _buckets(rows: DataFrame, copies: DataFrame | None) -> DataFrame:
    """sign, hot, node, lo, hi, m: signatures that several nodes hold, their leaders and how many rows hold them.

    copies: _id, _key of rows that don't sign.
    """
    sample = rows.filter(F.pmod(F.xxhash64("key", F.lit(1)), F.lit(SAMPLED)) == 0)
    total = sample.agg(F.count(F.lit(1)).alias("n"))
    hot = signed(sample).groupBy("sign").agg(F.count(F.lit(1)).alias("c")).filter("c >= 16").join(F.broadcast(total), F.col("c") > F.col("n") * HOT_SHARE)
    hot = stored(hot.select(F.col("sign").alias("_s")), "hot-signatures")
    if copies is not None:
        rows = rows.join(F.broadcast(copies), F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left_anti")
    each = signed(rows)
    if not hot.isEmpty():
        each = each.join(F.broadcast(hot), F.col("sign") == F.col("_s"), "left")
        each = each.select("node", "sign", F.when(F.col("_s").isNotNull(), F.pmod(F.xxhash64("node"), F.lit(SALTS))).otherwise(F.lit(-1)).cast("int").alias("salt"))
    else:
        each = each.withColumn("salt", F.lit(-1))
    bucket = Window.partitionBy("sign", "salt")
    each = each.withColumns({"lo": F.min("node").over(bucket), "hi": F.max("node").over(bucket), "m": F.count(F.lit(1)).over(bucket)})
    each = each.filter("lo < hi or salt >= 0").select("sign", (F.col("salt") >= 0).alias("hot"), "node", "lo", "hi", "m")
    return stored(each, "shared-signatures")


def _stars(shared: DataFrame) -> DataFrame:
    """a < b, c: every node with the leaders of its buckets, and in how many buckets; leaders of a hot signature's parts with those of all."""
    leaders = F.explode(F.array("lo", "hi")).alias("leader")
    own = shared.select("node", leaders)
    parts = shared.filter("hot").select("sign", "lo", "hi").distinct()  # as many as there are hot signatures, times SALTS
    ends = parts.groupBy("sign").agg(F.min("lo").alias("first"), F.max("hi").alias("last"))
    across = parts.join(ends, "sign").select(F.explode(F.array("lo", "hi")).alias("node"), "first", "last").select("node", F.explode(F.array("first", "last")).alias("leader"))
    pairs = own.unionByName(across).filter("node != leader").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))


def _with_links(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components when more links are known."""
    links = stored(links, "links")
    return found if links.isEmpty() else components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links))


def joined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, key (hash of the text), n (size of its set), node (equal for equal sets), component (smallest id), kept of every document.

    kept: of each component one pair of id and key, with the smallest id; of documents without shingles, all.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("key", text_key("text"))
    each = stored(rows.mapInPandas(_nodes, "id long, key long, n long, node long, sketch binary"), "shingle-nodes")
    row = F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "key")).alias("r")
    nodes = each.filter("n > 0").groupBy("node").agg(row, F.min(F.struct("n", "sketch")).alias("s"), F.count(F.lit(1)).alias("rows"))
    nodes = stored(nodes.select("node", F.col("r.id").alias("first"), "r.key", "s.n", "s.sketch", "rows"), "shingle-sets")
    shared = _buckets(rows, _copies(each, nodes))
    stars = stored(plausible(stored(_stars(shared), "star-pairs"), nodes), "stars")
    both = stars.select(F.col("a").alias("x"), F.col("b").alias("y"), "c").union(stars.select("b", "a", "c"))
    best = both.groupBy("x").agg(F.max(F.struct("c", "y"))["y"].alias("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    best = stored(best, "best-stars")
    links = stored(_links(best, nodes, rows), "links")
    # the other leaders of those that are not together yet
    first = components(links)
    label = lambda side: first.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
    apart = looked_up(looked_up(stars.select("a", "b"), label("a"), "a", "left"), label("b"), "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    found = _with_links(first, _links(stored(apart.join(best, ["a", "b"], "left_anti"), "candidates"), nodes, rows))
    members, tested = _members(shared), None
    faces = _faces(members, nodes)
    for most in ROUNDS:
        near = _rest(members, faces, found, most)
        if near is None or near.isEmpty():
            break
        fresh = near if tested is None else stored(near.join(F.broadcast(tested) if few(tested) else tested, ["a", "b"], "left_anti"), "candidates")
        found = _with_links(found, _links(fresh, nodes, rows))
        tested = near if tested is None else tested.union(fresh)
        # sets without such a pair have none later, when components have only grown; when none named as many as it could, all are named
        named = near.select(F.col("a").alias("node")).union(near.select("b")).groupBy("node").agg(F.count(F.lit(1)).alias("c"))
        named = stored(named, "named")
        if not most or named.filter(F.col("c") >= most).isEmpty():
            break
        members = stored(members.join(F.broadcast(named.select("node")) if few(named) else named.select("node"), "node", "left_semi"), "bucket-members")

    labels = looked_up(nodes.select("node", "first", "key"), found, "node", "left")
    labels = stored(labels.select("node", "first", "key", F.coalesce("component", "node").alias("component")), "labels")
    small = few(labels)
    least = labels.groupBy("component").agg(F.min(F.struct(F.col("first").isNull().alias("unknown"), "first", "node", "key")).alias("r"))
    least = least.select("component", F.col("r.first").alias("r_first"), F.col("r.node").alias("r_node"), F.col("r.key").alias("r_key"))
    labels = labels.select("node", "component")
    labels = stored((labels.join(F.broadcast(least), "component") if small else salted_join(labels, least, "component")).drop("component"), "labels")
    out = each.select("id", "key", "n", "node")
    out = out.join(F.broadcast(labels), "node", "left") if small else salted_join(out, labels, "node", "left")
    kept = (F.col("node") == F.col("r_node")) & F.col("id").eqNullSafe(F.col("r_first")) & (F.col("key") == F.col("r_key"))
    return out.select("id", "key", "n", "node", F.when(F.col("n") > 0, F.col("r_first")).otherwise(F.col("id")).alias("component"), F.when(F.col("n") > 0, kept).otherwise(True).alias("kept"))
