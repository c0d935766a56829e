"""Edit-aware token counts.

A document's state is a balanced tree over its pre-tokens: leaves hold a stretch of text with the lengths and token counts of its
pre-tokens, inner nodes the sums of their children. An edit replaces a stretch of characters. The tree finds the leaves that the stretch touches; text is
pre-tokenized anew from a boundary before the edit until its boundaries agree again with the old ones past it, and only those
pre-tokens are encoded. The leaves touched are replaced, by more or fewer where the edit inserts or deletes, and the sums on the paths above them
are made anew; nothing else is copied or moved. The root is the document's count.

A pre-token's extent depends on at most what follows it (white space looks one character ahead, a contraction two), so
the text before the last boundary at least LOOK characters in front of an edit is unaffected, and once a new boundary falls
on an old one behind the edit all later ones agree.

The leaves are also a column: states() gives them for a corpus, to be stored, and counted_again() applies later edits to them without
pre-tokenizing or encoding the rest again.

Defined results: a null text is an empty one with count 0; positions beyond the end mean the end; an edit may be empty,
delete everything or make the text longer; edits of a document apply in order, each to the result of the one before; repeated
rows each have a result; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeing

#: Fixed value: the pre-tokenization pattern of the vocabulary used.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPLIT = regex.compile(PATTERN)
#: Pre-tokens in a leaf, up to twice as many after edits; children of a node; characters in front of an edit that are looked at again.
LEAF, FAN, LOOK = 64, 16, 4
#: Counts of pre-tokens that a process remembers; it only saves time.
KNOWN = 300_000


class Counter:
    """Token counts of pre-tokens by a tiktoken vocabulary, each encoded once while it is remembered."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, int] = {}
        self.encoded = 0  # pre-tokens asked for so far

    def counts(self, words: list[str]) -> list[int]:
        self.encoded += len(words)
        known = self.known
        new = {w for w in words if w not in known}
        if new:
            if len(known) + len(new) > KNOWN:
                known.clear()
                new = set(words)
            for w in new:
                known[w] = len(self.encoding.encode_ordinary(w))
        return list(map(known.__getitem__, words))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


class Leaf:
    """A stretch of text and its pre-tokens."""

    __slots__ = ("text", "lengths", "counts", "chars", "tokens", "n")
    leaves = 1

    def __init__(self, text: str, lengths: list[int], counts: list[int]):
        self.text, self.lengths, self.counts = text, lengths, counts
        self.chars, self.tokens, self.n = len(text), sum(counts), len(counts)


class Node:
    """The sums of its children: leaves, or nodes of one level."""

    __slots__ = ("children", "chars", "tokens", "n", "leaves")

    def __init__(self, children: list):
        self.children = children
        self.add_up()

    def add_up(self) -> None:
        self.chars = sum(c.chars for c in self.children)
        self.tokens = sum(c.tokens for c in self.children)
        self.n = sum(c.n for c in self.children)
        self.leaves = sum(c.leaves for c in self.children)

    def replaced(self, lo: int, hi: int, new: list[Leaf]) -> list[Node]:
        """This node with leaves lo to hi replaced: none if nothing is left of it, several if it has grown too wide."""
        if all(isinstance(c, Leaf) for c in self.children):
            self.children[lo:hi] = new
        else:
            out, at, todo = [], 0, new
            for k, c in enumerate(self.children):
                a, b = max(lo - at, 0), min(hi - at, c.leaves)
                at += c.leaves
                here = a < b or (todo and a <= c.leaves and (a < c.leaves or k + 1 == len(self.children)))
                out += c.replaced(a, max(a, b), todo) if here else [c]
                todo = [] if here else todo
            self.children = out
        if len(self.children) > 2 * FAN:
            return [Node(self.children[k : k + FAN]) for k in range(0, len(self.children), FAN)]
        self.add_up()
        return [self] if self.children else []


def _leaves(text: str, lengths: list[int], counts: list[int]) -> list[Leaf]:
    """Leaves of about LEAF pre-tokens; one if they are less than twice as many."""
    parts = max(1, len(lengths) // LEAF) if len(lengths) > 2 * LEAF else 1
    out, at = [], 0
    for k in range(parts):
        a, b = len(lengths) * k // parts, len(lengths) * (k + 1) // parts
        end = at + sum(lengths[a:b])
        if a < b:
            out.append(Leaf(text[at:end], lengths[a:b], counts[a:b]))
        at = end
    return out


class Tree:
    """The state of one document."""

    def __init__(self, text: str, count: Counter):
        words = SPLIT.findall(text)
        self.counter = count
        self._grow(_leaves(text, list(map(len, words)), count.counts(words)))

    @staticmethod
    def of(leaves: list[dict], count: Counter) -> Tree:
        """The tree of leaves that states() gave: nothing is pre-tokenized or encoded."""
        tree = Tree("", count)
        tree._grow([Leaf(x["text"], list(map(int, x["lengths"])), list(map(int, x["counts"]))) for x in leaves])
        return tree

    def _grow(self, level: list) -> None:
        while len(level) > FAN:
            level = [Node(level[k : k + FAN]) for k in range(0, len(level), FAN)]
        self.root = Node(level)

    def leaves(self) -> list[Leaf]:
        level = self.root.children
        while level and isinstance(level[0], Node):
            level = [c for node in level for c in node.children]
        return level

    @property
    def total(self) -> int:
        return self.root.tokens

    @property
    def text(self) -> str:
        return "".join(x.text for x in self.leaves())

    def leaf(self, index: int) -> Leaf:
        node = self.root
        while isinstance(node, Node):
            for c in node.children:
                if index < c.leaves:
                    break
                index -= c.leaves
            node = c
        return node

    def find(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character, as its number, and where it begins."""
        node, index, start = self.root, 0, 0
        while isinstance(node, Node):
            for c in node.children:
                if char < start + c.chars:
                    break
                start += c.chars
                index += c.leaves
            node = c
        return index, start

    def edit(self, start: int, drop: int, put: str) -> int:
        """Replaces drop characters at start; returns how many pre-tokens were encoded anew."""
        start = max(0, min(start, self.root.chars))
        drop = max(0, min(drop, self.root.chars - start))
        shift = len(put) - drop
        index, begin = self.find(max(0, start - LOOK)) if self.root.leaves else (0, 0)
        window: list[Leaf] = []
        wide = 1
        while True:
            while index + len(window) < self.root.leaves and (len(window) < wide or begin + sum(x.chars for x in window) < start + drop):
                window.append(self.leaf(index + len(window)))
            more = index + len(window) < self.root.leaves
            old, lengths = "".join(x.text for x in window), [n for x in window for n in x.lengths]
            now = old[: start - begin] + put + old[start + drop - begin :]
            first, at = 0, 0  # the pre-token that holds the first character looked at
            while first < len(lengths) and at + lengths[first] <= max(0, start - LOOK) - begin:
                at += lengths[first]
                first += 1
            words, last, old_end, agreed = [], first, at, False  # old pre-tokens first to last, which end at old_end, are replaced
            for m in SPLIT.finditer(now, at):
                end = m.end()
                if more and end + LOOK > len(now):
                    break  # what comes behind the window may belong to it
                words.append(m.group())
                while last < len(lengths) and old_end + shift < end:
                    old_end += lengths[last]
                    last += 1
                if end >= start + len(put) - begin and old_end >= start + drop - begin and old_end + shift == end:
                    agreed = True
                    break
            if agreed or not more:
                break
            wide = 2 * len(window)
        last = last if agreed else len(lengths)
        counts = [n for x in window for n in x.counts]
        lengths[first:last] = map(len, words)
        counts[first:last] = self.counter.counts(words)
        nodes = self.root.replaced(index, index + len(window), _leaves(now, lengths, counts))
        self.root = nodes[0] if len(nodes) == 1 else Node(nodes)
        return len(words)


RESULT = "n_pretokens long, tokens_before long, tokens_after long, reencoded long, chars_after long, text_crc32 long"


STATE = "array<struct<text:string,lengths:array<int>,counts:array<int>>>"


def _edited(tree: Tree, edits) -> tuple:
    """The row of RESULT after the edits."""
    n, before = tree.root.n, tree.total
    again = sum(tree.edit(e["start"], e["drop"], e["put"]) for e in (edits if edits is not None else ()))
    crc = 0
    for x in tree.leaves():
        crc = zlib.crc32(x.text.encode("utf-8", "surrogatepass"), crc)
    return n, before, tree.total, again, tree.root.chars, crc


def _rows(path: str, keep: bool):
    @freeing
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(path)
        for df in parts:
            rows, states = [], []
            for k, edits in enumerate(df["edits"]):
                tree = Tree(df["text"].iloc[k] or "", count) if "text" in df else Tree.of(df["state"].iloc[k] if df["state"].iloc[k] is not None else [], count)
                rows.append(_edited(tree, edits))
                if keep:
                    states.append([{"text": x.text, "lengths": x.lengths, "counts": x.counts} for x in tree.leaves()])
            out = pd.concat((df[["id"]].reset_index(drop=True), pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])), axis=1)
            yield out.assign(state=states) if keep else out

    return run


def counted(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """id, pre-tokens and tokens before the edits, tokens after them, how many pre-tokens the edits had encoded anew, characters and CRC-32 of the edited text.

    edits: array of struct(start, drop, put), or null. No shuffle; a task holds one document's tree at a time.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(edits_col).alias("edits"))
    return rows.mapInPandas(_rows(path, False), f"id {rows.schema['id'].dataType.simpleString()}, {RESULT}")


def states(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and state, the leaves of every document's tree: a column to store for counted_again()."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.lit(None).cast("array<int>").alias("edits"))
    return rows.mapInPandas(_rows(path, True), f"id {rows.schema['id'].dataType.simpleString()}, {RESULT}, state {STATE}").select("id", "state")


def counted_again(rows: DataFrame, path: str, id_col: str = "id", state_col: str = "state", edits_col: str = "edits") -> DataFrame:
    """As counted(), of states instead of texts, with the state after the edits: only the regions that they touch are encoded. A null state is that of an empty text."""
    picked = rows.select(F.col(id_col).alias("id"), F.col(state_col).alias("state"), F.col(edits_col).alias("edits"))
    return picked.mapInPandas(_rows(path, True), f"id {picked.schema['id'].dataType.simpleString()}, {RESULT}, state {STATE}")
