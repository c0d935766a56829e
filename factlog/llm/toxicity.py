"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of a fixed lexicon of insults and of a lexicon learned from labelled rows (words and word
beginnings whose log-odds of toxic against clean texts are high), how many hits stand near a second-person pronoun,
capitals, punctuation and obfuscated words, and length. Labelled rows are split by a hash of their id into three parts:
one to learn the lexicon, one to fit the trees, one to calibrate, so that no part judges what it has seen. Each part is
bounded by a parameter, its rarer class less than the other, with weights that make up for it; everything else, features and scores, covers all rows. Trees and calibration are Spark's own.

Defined results: a null text is scored as an empty one; repeated rows have equal scores; where a part lacks one of the two
classes (a handful of labels) the score is that of the fixed lexicon alone, 0.9 with a hit and 0.1 without; labels that
are null or of unknown ids count nowhere; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import freeing, packed, stored

#: Labelled rows at most for the lexicon, the trees and the calibration.
BOUNDS = (20_000, 20_000, 10_000)
#: The share of a bound that the rarer class has at least, if there are so many labels of it.
RARE = 0.25
#: A learned term is in so many toxic texts of its part at least, and its log-odds are so high.
LEAST_TEXTS, LEAST_ODDS, TERMS = 6, 2.5, 2_000
BEGINNINGS = (5, 6, 7, 8)
NEAR = 6
# Words of insult, and pronouns of the second person.
INSULTS = frozenset(
    "idiot idiots moron morons stupid trash scum loser losers clown clowns pathetic worthless disgusting imbecile dumb filthy vermin garbage jerk creep freak ugly hate shut kill die "
    "idiota imbécil estúpido estúpida basura asqueroso asquerosa payaso inútil idiote imbécile stupide ordure dégoûtant minable clochard débile dumm dummkopf abschaum widerlich ekelhaft versager trottel müll".split()
)
SECOND_PERSON = frozenset("you your yours yourself u ur ya tu te ti tú vos usted ustedes vosotros contigo vous votre vos toi ton ta tes du dich dir dein deine deiner euch ihr sie".split())
WORDS = re.compile(r"\w+")
OBFUSCATED = re.compile(r"[A-Za-z][*@$#!0-9]+[A-Za-z]")
N_FEATURES = 13


def terms_of(word: str) -> list[str]:
    """The word, and its beginnings marked with a hyphen."""
    return [word] + [f"{word[:k]}-" for k in BEGINNINGS if len(word) >= k]


def features_of(text: str | None, weight: Callable[[str], float]) -> list[float]:
    text = text or ""
    words = WORDS.findall(text.lower())
    counts = Counter(words)
    n = max(len(words), 1)
    fixed = [w for w in counts if w in INSULTS]
    learned = {w: x for w in counts if (x := weight(w)) > 0}
    hits = set(fixed) | set(learned)
    total = sum(counts[w] for w in learned)
    close = 0
    if hits and not SECOND_PERSON.isdisjoint(counts):
        at = [k for k, w in enumerate(words) if w in SECOND_PERSON]
        marks = [k for k, w in enumerate(words) if w in hits]
        k = 0
        for m in marks:
            while k < len(at) and at[k] < m - NEAR:
                k += 1
            close += k < len(at) and at[k] <= m + NEAR
    letters = max(sum(map(len, words)), 1)
    capitals = sum(map(str.isupper, text)) if text.isascii() is False else len(text.translate(_ASCII_CAPITALS))
    return [
        sum(counts[w] for w in fixed) / n, float(len(fixed)), total / n, math.log1p(total), float(len(learned)), max(learned.values(), default=0.0),
        sum(counts[w] * x for w, x in learned.items()) / n, close / n, capitals / letters, text.count("!") / n, sum(map(text.count, "?.,;:*#$%&")) / n,
        len(OBFUSCATED.findall(text)) / n, math.log1p(len(words)),
    ]


_ASCII_CAPITALS = {c: None for c in range(128) if not 65 <= c <= 90}


def _term_counts(known: frozenset[str] | None) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """In how many texts of each batch terms are; known: only these."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            found: Counter[str] = Counter()
            for text in df["text"]:
                terms = {t for w in set(WORDS.findall((text or "").lower())) for t in terms_of(w)}
                found.update(terms if known is None else terms & known)
            if found:
                yield pd.DataFrame({"term": list(found), "n": list(found.values())})

    return run


def learned_terms(part: DataFrame) -> dict[str, float]:
    """Terms and their log-odds, TERMS at most, from rows text, toxic."""
    totals = {r["toxic"]: r["n"] for r in part.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    count = lambda toxic, known: part.filter(F.col("toxic") == toxic).select("text").mapInPandas(_term_counts(known), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    toxic = {r["term"]: r["n"] for r in count(1, None).filter(F.col("n") >= LEAST_TEXTS).orderBy(F.desc("n"), "term").limit(20 * TERMS).collect()}
    clean = {r["term"]: r["n"] for r in count(0, frozenset(toxic)).collect()}
    odds = {t: math.log((n + 0.5) / (totals.get(1, 0) + 1)) - math.log((clean.get(t, 0) + 0.5) / (totals.get(0, 0) + 1)) for t, n in toxic.items()}
    best = sorted((t for t in odds if odds[t] >= LEAST_ODDS), key=lambda t: (-odds[t], t))[:TERMS]
    return {t: odds[t] for t in best}


def features(text: Column, terms: dict[str, float]) -> Column:
    """The features of texts as array<double>."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, float] = {}

        def weight(word: str) -> float:
            if (x := known.get(word)) is None:
                if len(known) >= 100_000:
                    known.clear()
                x = known[word] = max((terms.get(t, 0.0) for t in terms_of(word)), default=0.0)
            return x

        for texts in parts:
            yield pd.Series([features_of(t, weight) for t in texts])

    run = freeing(run)
    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<double>")(text)


def kept_of(n: int, others: int, bound: int) -> int:
    """How many of n labels of one class are learned from, beside others of the other class: a rare class gets RARE of the bound, if it has so many."""
    fair = lambda x, y: min(x, max(round(bound * x / (x + y)), round(bound * RARE))) if x else 0
    return fair(n, others) if n <= others else min(n, bound - fair(others, n))


def in_parts(labels: DataFrame, bounds: tuple[int, ...] = BOUNDS) -> DataFrame:
    """id, toxic, part, weight of the labels to learn from: part 0 to 2 by tenths of a hash, each class of it cut by another hash; weight makes up for the cut."""
    tenth = F.pmod(F.xxhash64("id"), F.lit(10))
    rows = labels.filter(F.col("toxic").isin(0, 1)).select("id", F.col("toxic").cast("int").alias("toxic"), F.when(tenth < 4, 0).when(tenth < 8, 1).otherwise(2).alias("part"))
    sizes = {(r["part"], r["toxic"]): r["n"] for r in rows.groupBy("part", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = []
    for part, bound in enumerate(bounds):
        n = [sizes.get((part, c), 0) for c in (0, 1)]
        share += [kept_of(x, y, bound) / max(x, 1) for x, y in (n, n[::-1])]
    at = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("part") * 2 + F.col("toxic") + 1)
    rows = rows.filter(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1_000_003)) < at([int(1_000_003 * x) for x in share]))
    return rows.withColumn("weight", at([1 / x if x else 0.0 for x in share]))


class Scorer:
    """A fitted model: terms, trees and calibration; score() adds its column to any texts."""

    def __init__(self, labelled: DataFrame, iterations: int = 20, depth: int = 4):
        """labelled: text, toxic (0 or 1), part (0 to 2), weight."""
        self.terms = learned_terms(labelled.filter("part = 0"))
        both = stored(labelled.filter("part > 0").select("part", "weight", F.col("toxic").cast("double").alias("label"), features(F.col("text"), self.terms).alias("x")), "toxicity-features")
        fit, held = (both.filter(F.col("part") == k).select("label", "weight", "x") for k in (1, 2))
        self.trees = self.curve = None
        if all(p.select("label").distinct().count() == 2 for p in (fit, held)):
            gbt = GBTClassifier(featuresCol="v", labelCol="label", weightCol="weight", maxIter=iterations, maxDepth=depth, stepSize=0.2, seed=1, minInstancesPerNode=5)
            self.trees = gbt.fit(fit.select("label", "weight", array_to_vector("x").alias("v")))
            raw = self._raw(held).select("label", "weight", "raw")
            self.curve = IsotonicRegression(featuresCol="raw", labelCol="label", weightCol="weight", predictionCol="score").fit(raw)

    def _raw(self, rows: DataFrame) -> DataFrame:
        out = self.trees.transform(rows.withColumn("v", array_to_vector("x")))
        return out.withColumn("raw", vector_to_array("rawPrediction")[1]).drop("v", "rawPrediction", "probability", "prediction")

    def score(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """_row (the document) and score."""
        rows = docs.select(packed(docs), features(F.col(text_col).cast("string"), self.terms).alias("x"))
        if self.trees is None:
            return rows.select("_row", F.when(F.col("x")[1] > 0, 0.9).otherwise(0.1).alias("score"))
        return self.curve.transform(self._raw(rows)).select("_row", F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)).alias("score"))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text divides by 5."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, bounds: tuple[int, ...] = BOUNDS, **options) -> Scorer:
    """A scorer from the labelled documents that aren't held out. labels: doc_id, toxic.

    The labels of the three parts, of which bounds says how many there are, go to the texts; texts don't move.
    """
    known = in_parts(labels.select(F.col("doc_id").alias("id"), "toxic").filter(~held_out(F.col("id"))), bounds).withColumnRenamed("id", "_id")
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), F.col("id") == F.col("_id"))
    return Scorer(stored(rows.select("text", "toxic", "part", "weight"), "toxicity-labelled"), **options)


def scored(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """_row (the document) and score of every document."""
    return fitted(docs, labels, **options).score(docs)
