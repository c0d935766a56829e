"""Secret scan, with DataFrame functions only.

Base patterns give spans of kinds assign, access and hex. The method adds spans of kind random: runs of token characters
for which an encoding can be inferred (hex, base32, single-case alphanumeric or base64) and which a battery of
randomness tests cannot tell from uniform symbols of that encoding: chi-squared uniformity of the alphabet's symbols and of its
classes (capitals, small letters, others), the runs test about its middle and of classes, and lag-1 serial correlation, joined by
Bonferroni. Symbols are many for a short token and their chi-squared is rough; classes are three at most, and names in camel case, which mix
them unlike chance, fail on them. A single-case word, however long, has no such encoding.

Every token is tested, so some random ones would be thrown out by chance and, in short ones, structure is hard to see.
Rejections are therefore controlled with Benjamini-Hochberg within each length class (powers of two), over the tokens of
the whole corpus; p-values count on a grid of three digits, so that a class's curve is a small table. Tokens that remain
unrejected and overlap no base span are reported. So the share of random tokens that are lost is controlled; how many ordinary ones are reported is measured (tests).

Defined results: a null text is empty; a row without spans has zeros, the hash of the empty string and an empty spans
string; repeated rows each have a result of their own; an empty table gives an empty result. Positions are code points,
ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_of

#: Kind: pattern, the group whose length counts, its least length. In the order in which spans at one start are listed.
PATTERNS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
}
RANDOM = "random"
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
#: Rejected tokens may hold this share of truly random ones.
FALSE_REJECTIONS = 0.05
#: Encodings in the order in which they are inferred: pattern, alphabet in order.
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (
    (r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", "0123456789abcdef"),
    (r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", "0123456789ABCDEF"),
    (r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+=*$", UPPER + "234567"),
    (r"^(?=.*[0-9])(?=.*[a-z])[a-z0-9]+$", DIGITS + LOWER),
    (r"^(?=.*[0-9])(?=.*[A-Z])[A-Z0-9]+$", DIGITS + UPPER),
    (r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/]+=*$", UPPER + LOWER + DIGITS + "+/"),
    (r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9_-]+=*$", UPPER + LOWER + DIGITS + "-_"),
)
# Coefficients of the usual rational approximation of erfc, highest power first.
ERFC = (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223)


def two_sided(z: Column) -> Column:
    """The probability that a normal variable lies at least so far from 0."""
    x = F.abs(z) / 2**0.5
    t = 1 / (1 + 0.5 * x)
    poly = F.lit(ERFC[0])
    for c in ERFC[1:]:
        poly = poly * t + c
    return F.least(F.greatest(t * F.exp(poly - x * x), F.lit(1e-15)), F.lit(1.0))


def encoded(token: Column) -> Column:
    """The alphabet of the inferred encoding, or null."""
    out = F.lit(None).cast("string")
    for pattern, alphabet in reversed(ENCODINGS):
        out = F.when(token.rlike(pattern), F.lit(alphabet)).otherwise(out)
    return out


#: The classes of symbols, as patterns of what is none of them.
CLASSES = ("[^A-Z]", "[^a-z]", "[A-Za-z]")


def p_values(tokens: DataFrame) -> DataFrame:
    """Adds p of each test and p of all to rows with match and alphabet; characters outside the alphabet (padding) don't count."""
    symbols = F.expr("filter(split(rtrim('=', match), ''), c -> instr(alphabet, c) > 0)")
    t = tokens.withColumn("s", symbols).withColumn("v", F.expr("transform(s, c -> cast(instr(alphabet, c) - 1 as double))"))
    t = t.withColumn("n", F.size("v").cast("double")).withColumn("a", F.length("alphabet").cast("double"))
    # chi-squared of the symbols' counts, as a normal variable by the cube-root transformation
    squares = F.expr("aggregate(array_distinct(v), 0D, (s, x) -> s + power(size(filter(v, y -> y = x)), 2))")
    df = F.col("a") - 1
    z1 = (F.cbrt((squares * F.col("a") / F.col("n") - F.col("n")) / df) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    # chi-squared of the classes' counts: exact tail for three classes, of a normal variable for two
    share = [F.length(F.regexp_replace("alphabet", c, "")) / F.col("a") for c in CLASSES]
    t = t.withColumn("e", F.array(*share)).withColumn("k", F.expr("transform(s, c -> case when c between 'A' and 'Z' then 0 when c between 'a' and 'z' then 1 else 2 end)"))
    off = F.expr("aggregate(sequence(0, 2), 0D, (s, j) -> s + if(e[j] > 0, power(size(filter(k, x -> x = j)) - n * e[j], 2) / (n * e[j]), 0D))")
    classes = F.expr("size(filter(e, x -> x > 0))")
    by_class = F.when(classes == 3, F.greatest(F.exp(-off / 2), F.lit(1e-15))).when(classes == 2, two_sided(F.sqrt(off))).otherwise(1.0)
    # how often the class changes from one symbol to the next
    t = t.withColumn("q", F.expr("1 - aggregate(e, 0D, (s, x) -> s + x * x)")).withColumn("q3", F.expr("aggregate(e, 0D, (s, x) -> s + x * (1 - x) * (1 - x))"))
    changes = F.expr("aggregate(sequence(1, size(k) - 1), 0D, (s, i) -> s + cast(k[i] != k[i - 1] as int))")
    spread_of = (F.col("n") - 1) * F.col("q") * (1 - F.col("q")) + 2 * (F.col("n") - 2) * (F.col("q3") - F.col("q") * F.col("q"))
    z4 = F.when(spread_of > 0, (changes - (F.col("n") - 1) * F.col("q")) / F.sqrt(spread_of)).otherwise(0.0)
    # runs above and below the middle of the alphabet
    t = t.withColumn("up", F.expr("transform(v, x -> cast(x >= a / 2 as int))"))
    t = t.withColumn("n1", F.expr("aggregate(up, 0D, (s, x) -> s + x)")).withColumn("n2", F.col("n") - F.col("n1"))
    runs = F.expr("1D + aggregate(sequence(1, size(up) - 1), 0D, (s, k) -> s + cast(up[k] != up[k - 1] as int))")
    mean = 2 * F.col("n1") * F.col("n2") / F.col("n") + 1
    var = (mean - 1) * (mean - 2) / (F.col("n") - 1)
    z2 = F.when(var > 0, (runs - mean) / F.sqrt(var)).otherwise(F.sqrt("n"))
    # lag-1 correlation of the symbols' places in the alphabet
    t = t.withColumn("m", F.expr("aggregate(v, 0D, (s, x) -> s + x) / n"))
    spread = F.expr("aggregate(v, 0D, (s, x) -> s + (x - m) * (x - m))")
    lagged = F.expr("aggregate(sequence(1, size(v) - 1), 0D, (s, k) -> s + (v[k] - m) * (v[k - 1] - m))")
    z3 = F.when(spread > 0, (lagged / spread + 1 / F.col("n")) * F.sqrt("n")).otherwise(F.sqrt("n"))
    each = {"p_uniform": two_sided(z1), "p_classes": by_class, "p_runs": two_sided(z2), "p_changes": two_sided(z4), "p_serial": two_sided(z3)}
    t = t.withColumns(each)
    return t.withColumn("p", F.least(len(each) * F.least(*each), F.lit(1.0))).drop("s", "v", "a", "e", "k", "q", "q3", "up", "n1", "n2", "m")


def rejected(tested: DataFrame, share: float = FALSE_REJECTIONS) -> DataFrame:
    """length_class, limit: tokens of the class with p <= limit are not random. tested has p and n."""
    digits = F.pow(F.lit(10.0), 2 - F.floor(F.log10("p")))
    graded = tested.select(F.floor(F.log2("n")).cast("int").alias("length_class"), (F.ceil(F.col("p") * digits) / digits).alias("grade"))
    curve = graded.groupBy("length_class", "grade").count()  # a few thousand rows a class at most
    up = Window.partitionBy("length_class").orderBy("grade")
    curve = curve.withColumn("k", F.sum("count").over(up)).withColumn("m", F.sum("count").over(Window.partitionBy("length_class")))
    return curve.filter(F.col("grade") <= share * F.col("k") / F.col("m")).groupBy("length_class").agg(F.max("grade").alias("limit"))


def _hits(text: Column, kind: str, pattern: str) -> Column:
    """What lies before each match, as a length, and the match: one struct for each match; null where there is none."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    both = F.filter(F.arrays_zip(gaps.alias("gap"), matches.alias("match")), lambda x: x["match"].isNotNull())
    return F.when(text.rlike(pattern), F.transform(both, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), x["gap"].alias("gap"), x["match"].alias("match"))))


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rid, id, hits of every row, in a table; the one pass over the texts."""
    text = F.col("_text")
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), text_of(text_col).alias("_text"))
    kinds = {k: p for k, (p, _, _) in PATTERNS.items()} | {RANDOM: TOKEN}
    none = F.array().cast("array<struct<kind:string,i:int,gap:int,match:string>>")
    hits = F.concat(*[F.coalesce(_hits(text, k, p), none) for k, p in kinds.items()])
    return stored(rows.select("rid", "id", hits.alias("hits")), "secret-hits")


def spans(hits: DataFrame, share: float = FALSE_REJECTIONS) -> DataFrame:
    """rid, kind, start, end, match of every span, from found()."""
    rows = hits.select("rid", F.explode("hits").alias("h")).select("rid", "h.*")
    order = Window.partitionBy("rid", "kind").orderBy("i")
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.char_length("match")).over(order).cast("int"))
    rows = rows.withColumn("start", F.col("end") - F.char_length("match"))
    good = F.lit(False)
    for kind, (pattern, group, least) in PATTERNS.items():
        part = F.regexp_extract("match", pattern, group) if group else F.col("match")
        good = F.when(F.col("kind") == kind, F.char_length(part) >= least).otherwise(good)
    good = F.when(F.col("kind") == RANDOM, encoded(F.col("match")).isNotNull()).otherwise(good)
    rows = rows.filter(good)
    # overlap with base spans: the furthest end of those that start before, the nearest start of those after
    rank = F.array_position(F.array(*[F.lit(k) for k in PATTERNS]), F.col("kind"))
    rank = F.when(F.col("kind") == RANDOM, len(PATTERNS) + 1).otherwise(rank).cast("int")
    base_end, base_start = (F.when(F.col("kind") != RANDOM, F.col(c)) for c in ("end", "start"))
    before = Window.partitionBy("rid").orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("rid").orderBy(F.col("start").desc(), F.col("rank").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("rank", rank)
    rows = rows.withColumn("reach", F.max(base_end).over(before)).withColumn("next", F.min(base_start).over(after))
    clear = (F.coalesce(F.col("reach"), F.lit(0)) <= F.col("start")) & (F.coalesce(F.col("next"), F.col("end")) >= F.col("end"))
    rows = stored(rows.filter((F.col("kind") != RANDOM) | clear).select("rid", "kind", "rank", "start", "end", "match"), "secret-spans")
    base = rows.filter(F.col("kind") != RANDOM)
    tested = p_values(rows.filter(F.col("kind") == RANDOM).withColumn("alphabet", encoded(F.col("match"))))
    limits = F.broadcast(rejected(tested, share).withColumnRenamed("length_class", "_class"))  # a row for each power of two
    kept = tested.join(limits, F.floor(F.log2("n")).cast("int") == F.col("_class"), "left").filter(F.col("limit").isNull() | (F.col("p") > F.col("limit")))
    return base.unionByName(kept.select(base.columns))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = FALSE_REJECTIONS) -> DataFrame:
    """One row per row of docs: id, spans: array of struct(start, rank, kind, end) in order."""
    hits = found(docs, id_col, text_col)
    each = spans(hits, share).groupBy(F.col("rid").alias("_rid")).agg(F.sort_array(F.collect_list(F.struct("start", "rank", "kind", "end"))).alias("spans"))
    out = hits.select("rid", "id").join(each, F.col("rid") == F.col("_rid"), "left")
    return out.select("id", F.coalesce("spans", F.array().cast(each.schema["spans"].dataType)).alias("spans"))
