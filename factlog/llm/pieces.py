"""SentencePiece encoding and decoding with N-best segmentation.

A text's lattice has an arc for every piece of the model that spells a stretch of it. Forward Viterbi gives the best
score of every prefix. Searching back from the end, these scores are the exact cost still to come, so an A* search
completes the N best paths in order without ever extending a path that isn't among them.

No piece spells across certain places (before white space that follows something else, and around characters that no longer piece holds), so the lattice falls apart into segments, mostly words, and paths are chosen in each on their own.
Equal segments of a batch are solved once: Viterbi runs over all segments of one length together, in numpy, and gives
the gap between the best path and the next one. Of a whole text only segments with the smallest gaps can deviate in its N best
paths; the search goes back over those, with the A* search of each segment giving its ways in order.

Scores are the model's own for a unigram model. A BPE model has merge ranks instead, which don't add up along a path;
there a piece's score is the Zipf estimate -log(rank + 2). Characters outside the model cost more than any piece and
become their UTF-8 bytes' pieces.

Defined results: a null text has null pieces; an empty one has no pieces and one way with score 0; texts of any length
are encoded whole; decoding gives the text back exactly when the model neither folds characters nor drops white space; repeated rows
each have a result; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, freeing
from .hashing import U, ranges

SPACE_MARK = "▁"
#: Paths that a text has besides the best one.
MORE = 3
#: Scores are rounded to multiples of 1 / GRID: sums of them are exact in any order, so that ties are ties.
GRID = 2**20
#: Segments longer than this are solved one by one.
LONG = 40
#: Segments that a process remembers; the first it meets, so mostly the frequent ones. It only saves time.
KNOWN, KNOWN_WAYS = 400_000, 20_000
#: Bytes of text encoded at a time; and segments hashed or pieces decoded at a time, whose indices take 8 bytes for each character.
PART, BLOCK = 1_000_000, 1 << 15
ROWS = "pieces array<int>, score double, others array<struct<score:double,changes:array<struct<at:int,drop:int,put:array<int>>>>>"
_BASE = U(0x9E3779B97F4A7C15)


class Model:
    """The pieces of a SentencePiece model and what encoding needs of them."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(SentencePieceProcessor(model_file=path).serialized_model_proto())
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces:
            raise ValueError("the model changes texts before encoding; pieces wouldn't decode to the text")
        self.prefix = bool(spec.add_dummy_prefix)
        bpe = proto.trainer_spec.model_type == pb.TrainerSpec.BPE
        self.bytes = np.full(256, -1, np.int32)
        self.scores: dict[str, tuple[float, int]] = {}
        kinds = pb.ModelProto.SentencePiece
        self.spelled: list[bytes] = []
        for i, p in enumerate(proto.pieces):
            self.spelled.append(b"")
            if p.type == kinds.BYTE:
                self.bytes[int(p.piece[3:5], 16)] = i
                self.spelled[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type in (kinds.NORMAL, kinds.USER_DEFINED):
                score = -math.log(-p.score + 2) if bpe else p.score
                self.scores[p.piece] = (round(score * GRID) / GRID, i)
                self.spelled[i] = p.piece.replace(SPACE_MARK, " ").encode()
        if (self.bytes < 0).any():
            raise ValueError("the model has no byte pieces; characters outside it couldn't be decoded")
        self.unknown = min(s for s, _ in self.scores.values()) - 10.0
        self.longest = max(map(len, self.scores))
        inner = {c for p in self.scores for c in p if len(p) > 1}
        self.joining = np.zeros(0x110000, bool)  # characters that some longer piece holds
        self.joining[[ord(c) for c in inner]] = True
        self.cut_at_space = not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in self.scores)
        # a hash table of all pieces by length: slots of (hash, score, id)
        self.powers = np.multiply.accumulate(np.full(self.longest, _BASE, np.uint64))
        self.bits = int(np.ceil(np.log2(len(self.scores) * 8)))
        self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits)
        self.ids = np.zeros(1 << self.bits, np.int32)
        for p, (score, i) in self.scores.items():
            key = self.hashed(np.array([[ord(c) + 1 for c in p]], np.uint64))[0]
            at = int(key >> U(64 - self.bits))
            while self.keys[at]:
                at = (at + 1) % len(self.keys)
            self.keys[at], self.values[at], self.ids[at] = key, score, i
        # what this process has solved already
        self.known = np.empty(0, np.uint64)  # hashes of segments, sorted
        self.solved = np.empty((4, 0))  # their score, gap, number of pieces, and where those begin in known_ids
        self.known_ids = np.empty(0, np.int32)
        self.known_ways: dict[str, list[tuple[float, tuple[int, ...]]]] = {}

    def hashed(self, chars: np.ndarray) -> np.ndarray:
        h = (chars * self.powers[: chars.shape[1]]).sum(axis=1, dtype=np.uint64)
        return (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9) | U(1)

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores (-inf for no piece) and ids of hashed stretches."""
        at = (h >> U(64 - self.bits)).astype(np.int64)
        score, ids = np.full(len(h), -np.inf), np.zeros(len(h), np.int32)
        open_ = np.flatnonzero(self.keys[at])
        while len(open_):
            slot = at[open_]
            hit = self.keys[slot] == h[open_]
            score[open_[hit]], ids[open_[hit]] = self.values[slot[hit]], self.ids[slot[hit]]
            open_ = open_[~hit]
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            open_ = open_[self.keys[at[open_]] != 0]
        return score, ids

    def arcs(self, segment: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """For every end the arcs that arrive there: start, score, pieces."""
        out: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(len(segment) + 1)]
        for end in range(1, len(segment) + 1):
            for start in range(max(0, end - self.longest), end):
                if (hit := self.scores.get(segment[start:end])) is not None:
                    out[end].append((start, hit[0], (hit[1],)))
            if segment[end - 1] not in self.scores:
                raw = segment[end - 1].replace(SPACE_MARK, " ").encode("utf-8", "surrogatepass")
                out[end].append((end - 1, self.unknown, tuple(self.bytes[list(raw)].tolist())))
        return out

    def ways(self, segment: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best paths of one segment in order: score, pieces. Ties come in the order of the search, which is fixed."""
        arcs = self.arcs(segment)
        best = [0.0] + [-math.inf] * len(segment)
        for end in range(1, len(best)):
            best[end] = max(best[start] + score for start, score, _ in arcs[end])
        heap = [(-best[-1], len(segment), 0, 0.0, None)]
        out, made = [], 0
        while heap and len(out) < n:
            _, at, _, behind, path = heapq.heappop(heap)
            if at == 0:
                pieces: list[int] = []
                while path is not None:
                    pieces += path[0]
                    path = path[1]
                out.append((behind, tuple(pieces)))
                continue
            for start, score, pieces in arcs[at]:
                made += 1
                heapq.heappush(heap, (-(best[start] + score + behind), start, made, behind + score, (pieces, path)))
        return out

    def ways_known(self, segment: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        found = self.known_ways.get(segment)
        if found is None or len(found) < n and len(found) > 1:
            if len(self.known_ways) >= KNOWN_WAYS:
                self.known_ways.clear()
            found = self.known_ways[segment] = self.ways(segment, n)
        return found[:n]


@lru_cache(maxsize=4)
def model(path: str) -> Model:
    return Model(path)


def _solved(m: Model, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Viterbi over segments of one length, one a row: score, gap to the next path, pieces in one row after another, how many each has."""
    rows, length = chars.shape
    code = chars.astype(np.uint64) + U(1)
    longest = min(m.longest, length)
    score = np.full((length, longest + 1, rows), -np.inf)  # by start and size
    ids = np.zeros((length, longest + 1, rows), np.int32)
    for start in range(length):
        h = np.zeros(rows, np.uint64)
        for size in range(1, min(longest, length - start) + 1):
            h = h + code[:, start + size - 1] * m.powers[size - 1]
            key = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9) | U(1)
            score[start, size], ids[start, size] = m.lookup(key)
        lone = np.isneginf(score[start, 1])
        score[start, 1, lone], ids[start, 1, lone] = m.unknown, -1
    ahead = np.full((length + 1, rows), -np.inf)
    ahead[0] = 0
    last = np.zeros((length + 1, rows), np.int64)
    for end in range(1, length + 1):
        sizes = range(1, min(longest, end) + 1)
        ways = np.stack([ahead[end - s] + score[end - s, s] for s in sizes])
        pick = ways.argmax(axis=0)
        ahead[end], last[end] = np.take_along_axis(ways, pick[None], 0)[0], pick + 1
    behind = np.full((length + 1, rows), -np.inf)
    behind[length] = 0
    for start in range(length - 1, -1, -1):
        behind[start] = np.max([behind[start + s] + score[start, s] for s in range(1, min(longest, length - start) + 1)], axis=0)
    # the path back; any other path has an arc off it, and the best through each arc is known
    at, used = np.full(rows, length), np.zeros((length, longest + 1, rows), bool)
    each = np.arange(rows)
    while (on := at > 0).any():
        size = last[at[on], each[on]]
        at[on] -= size
        used[at[on], size, each[on]] = True
    second = np.full(rows, -np.inf)
    for start in range(length):
        for size in range(1, min(longest, length - start) + 1):
            through = ahead[start] + score[start, size] + behind[start + size]
            np.maximum(second, np.where(used[start, size], -np.inf, through), out=second)
    row, start, size = np.nonzero(used.transpose(2, 0, 1))
    return ahead[length], ahead[length] - second, ids[start, size, row], np.bincount(row, minlength=rows), row, start


def _bytes_of(m: Model, char: int) -> list[int]:
    raw = b" " if char == ord(SPACE_MARK) else chr(char).encode("utf-8", "surrogatepass")
    return m.bytes[list(raw)].tolist()


def _unknown(m: Model, chars: np.ndarray, ids: np.ndarray, counts: np.ndarray, row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters outside the model (-1) become their bytes."""
    lost = np.flatnonzero(ids < 0)
    if not len(lost):
        return ids, counts
    put = [_bytes_of(m, int(c)) for c in chars[row[lost], start[lost]]]
    repeats = np.ones(len(ids), np.int64)
    repeats[lost] = [len(p) for p in put]
    out = np.repeat(ids, repeats)
    out[np.repeat(ids < 0, repeats)] = np.concatenate(put)
    return out, np.bincount(row, weights=repeats, minlength=len(counts)).astype(np.int64)


def _solve(m: Model, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    score, gap, ids, counts, row, start = _solved(m, chars)
    ids, counts = _unknown(m, chars, ids, counts, row, start)
    return score, gap, ids, counts


def _solve_all(m: Model, chars: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score, gap, number of pieces and their place, a column for each segment; and the pieces."""
    n = len(begin)
    out = np.zeros((4, n))
    found, done = [], 0
    order = np.argsort(size, kind="stable")
    bounds = np.flatnonzero(np.diff(size[order], prepend=-1, append=-1)) if n else np.empty(0, np.int64)
    for a, b in zip(bounds[:-1], bounds[1:]):
        length = int(size[order[a]])
        step = max(1, 400_000 // (length * min(length, m.longest))) if length <= LONG else 1
        for c in range(a, b, step):
            mine = order[c : min(b, c + step)]
            if length <= LONG:
                s, g, ids, k = _solve(m, chars[begin[mine][:, None] + np.arange(length)])
            else:
                paths = m.ways("".join(map(chr, chars[begin[mine[0]] :][:length])), 2)
                s, ids = np.array([paths[0][0]]), np.array(paths[0][1], np.int32)
                g, k = np.array([paths[0][0] - paths[1][0] if len(paths) > 1 else np.inf]), np.array([len(ids)])
            out[:, mine] = s, g, k, done + np.cumsum(k) - k
            found.append(ids)
            done += len(ids)
    return out, np.concatenate(found) if found else np.empty(0, np.int32)


def _deviations(m: Model, segments: list[tuple[str, tuple[int, ...]]], more: int) -> list[tuple[float, tuple[tuple[int, tuple[int, ...]], ...]]]:
    """The next best paths of a whole text, from the segments that may deviate: loss, which segment takes which pieces."""
    ways = []
    for segment, best in segments:  # of paths with equal scores, the one that Viterbi took is the first
        found = m.ways_known(segment, more + 1)
        ways.append([(found[0][0], best)] + [w for w in found if w[1] != best][:more])
    heap, out = [(0.0, -1, ())], []
    # a path is a set of deviations; extended only past its last segment, or by the next way of it, each path is met once
    while heap and len(out) <= more:
        loss, last, path = heapq.heappop(heap)
        out.append((loss, path))
        if path:
            k, w = path[-1]
            if w + 1 < len(ways[k]):
                heapq.heappush(heap, (loss - (ways[k][w + 1][0] - ways[k][w][0]), last, (*path[:-1], (k, w + 1))))
        for k in range(last + 1, len(ways)):
            if len(ways[k]) > 1:
                heapq.heappush(heap, (loss - (ways[k][1][0] - ways[k][0][0]), k, (*path, (k, 1))))
    return [(loss, tuple((k, ways[k][w][1]) for k, w in path)) for loss, path in out[1:]]


def _hashes(chars: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of segments that follow one another."""
    powers = np.multiply.accumulate(np.full(int(size.max(initial=1)), _BASE, np.uint64))
    h = np.empty(len(begin), np.uint64)
    for a in range(0, len(begin), BLOCK):
        at, per = begin[a : a + BLOCK] - begin[a], size[a : a + BLOCK]
        code = powers[np.arange(int(per.sum())) - np.repeat(at, per)]
        code *= chars[begin[a] :][: len(code)] + U(1)
        h[a : a + BLOCK] = np.add.reduceat(code, at)
    return (h ^ (h >> U(31))) * U(0x94D049BB133111EB) + size.astype(np.uint64)


def encode(m: Model, texts: list[str | None], more: int = MORE):
    """For texts of a few megabytes: all pieces in a row, how many each text has, scores, and for each text its other paths as (score, changes)."""
    marked = [((" " if m.prefix and t else "") + (t or "")).replace(" ", SPACE_MARK) for t in texts]
    chars = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.cumsum([0] + [len(t) for t in marked])
    first = np.zeros(len(chars) + 1, bool)  # where segments begin
    first[starts] = True
    joins = m.joining[chars]
    first[:-1] |= ~joins
    first[1:] |= ~joins
    if m.cut_at_space:
        space = chars == ord(SPACE_MARK)
        first[1:-1] |= space[1:] & ~space[:-1]
    begin = np.flatnonzero(first[:-1])
    size = np.diff(np.append(begin, len(chars)))
    hashes, some, which = np.unique(_hashes(chars, begin, size), return_index=True, return_inverse=True)
    new = np.flatnonzero(~np.isin(hashes, m.known, assume_unique=True))
    solved, ids = _solve_all(m, chars, begin[some[new]], size[some[new]])
    score, gap, counts, at = np.zeros((4, len(some)))
    old = np.setdiff1d(np.arange(len(some)), new, assume_unique=True)
    for out, fresh, known in zip((score, gap, counts, at), solved, m.solved):
        out[new] = fresh
        out[old] = known[np.searchsorted(m.known, hashes[old])]
    at[old] += len(ids)
    counts, at = counts.astype(np.int64), at.astype(np.int64)
    all_ids = np.concatenate((ids, m.known_ids))
    if len(m.known) + len(new) <= KNOWN:
        solved[3] += len(m.known_ids)
        order = np.argsort(merged := np.concatenate((m.known, hashes[new])), kind="stable")
        m.known, m.solved = merged[order], np.concatenate((m.solved, solved), axis=1)[:, order]
        m.known_ids = np.concatenate((m.known_ids, ids))
    ids = all_ids
    per = counts[which]
    offsets = np.cumsum(per) - per
    pieces = ids[np.repeat(at[which] - offsets, per) + np.arange(int(per.sum()))]
    text_of = np.searchsorted(begin, starts)
    ends = np.concatenate((offsets, [len(pieces)]))
    lengths = ends[text_of[1:]] - ends[text_of[:-1]]
    scores = np.array([math.fsum(score[which[a:b]]) for a, b in zip(text_of[:-1], text_of[1:])]) if len(texts) else np.empty(0)
    others = []
    for t, (a, b) in enumerate(zip(text_of[:-1], text_of[1:])):
        gaps = gap[which[a:b]]
        least = a + np.sort(np.argsort(gaps, kind="stable")[:more])
        least = [int(k) for k in least if gap[which[k]] < np.inf]
        near = [("".join(map(chr, chars[begin[k] : begin[k] + size[k]])), tuple(pieces[offsets[k] : offsets[k] + per[k]].tolist())) for k in least]
        out = []
        for loss, path in _deviations(m, near, more):
            changes = []
            for k, put in path:
                seg = least[k]
                changes.append({"at": int(offsets[seg] - ends[a]), "drop": int(per[seg]), "put": list(put)})
            out.append({"score": scores[t] - loss, "changes": changes})
        others.append(out)
    return pieces, lengths, scores, others


def decode(m: Model, pieces: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """The texts of pieces in a row, as UTF-8."""
    table = np.frombuffer(b"".join(m.spelled), np.uint8)
    sizes = np.array([len(s) for s in m.spelled])
    at = np.cumsum(sizes) - sizes
    per = sizes[pieces]
    ends = np.concatenate(([0], np.cumsum(per)))

    def spelled(a: int, b: int) -> bytes:
        return table[np.repeat(at[pieces[a:b]] - ends[a:b], per[a:b]) + np.arange(ends[a], ends[b])].tobytes()

    flat = b"".join(spelled(a, min(a + BLOCK, len(pieces))) for a in range(0, len(pieces), BLOCK))
    bounds = ends[np.concatenate(([0], np.cumsum(lengths)))]
    return [flat[a + (m.prefix and b > a) : b] for a, b in zip(bounds[:-1], bounds[1:])]


def _encoding(path: str, more: int, schema: pa.Schema):
    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            texts = batch.column("text")
            for a, b in ranges(pc.binary_length(texts).fill_null(0).to_pylist(), PART):
                part = texts.slice(a, b - a).to_pylist()
                pieces, lengths, scores, others = encode(m, part, more)
                back = decode(m, pieces, lengths)
                same = [None if t is None else x == t.encode("utf-8", "surrogatepass") for t, x in zip(part, back)]
                null = pa.array([t is None for t in part])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), pa.array(pieces, pa.int32()), mask=null)
                columns = [batch.column("id").slice(a, b - a), lists, pa.array(scores, mask=np.asarray(null)), pa.array([None if t is None else o for t, o in zip(part, others)], schema.field("others").type), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
                free()

    return run


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", more: int = MORE) -> DataFrame:
    """id, pieces, score, others (the next best paths: what they change in the best one), lossless (whether decoding gives the text back).

    No shuffle: each task encodes its own texts, a few megabytes at a time.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    change = pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("put", pa.list_(pa.int32()))])
    other = pa.struct([("score", pa.float64()), ("changes", pa.list_(change))])
    kind = rows.schema["id"].dataType.simpleString()
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    schema = pa.schema([("id", arrow), ("pieces", pa.list_(pa.int32())), ("score", pa.float64()), ("others", pa.list_(other)), ("lossless", pa.bool_())])
    return rows.mapInArrow(_encoding(path, more, schema), f"id {kind}, {ROWS}, lossless boolean")


def decoded(rows: DataFrame, path: str, id_col: str = "id", pieces_col: str = "pieces") -> DataFrame:
    """id, text of pieces."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model(path)
        for df in parts:
            lists = [np.empty(0, np.int32) if p is None else np.asarray(p, np.int32) for p in df["pieces"]]
            flat = np.concatenate(lists) if lists else np.empty(0, np.int32)
            texts = decode(m, flat, np.array([len(p) for p in lists], np.int64))
            yield pd.DataFrame({"id": df["id"], "text": [None if p is None else t.decode("utf-8", "surrogatepass") for p, t in zip(df["pieces"], texts)]})

    picked = rows.select(F.col(id_col).alias("id"), F.col(pieces_col).alias("pieces"))
    return picked.mapInPandas(run, f"id {picked.schema['id'].dataType.simpleString()}, text string")
