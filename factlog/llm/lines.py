"""Line deduplication over the whole corpus, with DataFrame functions only.

Lines become 128-bit hashes of their keys. The hashes are range-partitioned and sorted by (hash, document, position),
so that the first document of every key streams past first. The result is not text but, for each document, which of
its lines go: a bitmap in words of 64 lines, of which only words with a bit are kept.

A key that a large share of the lines holds would land in one range. Such keys are found in a sample of the documents
(that only decides how they are treated, never the result); their first documents come from a pre-aggregated minimum
over all rows, and their lines never enter the range shuffle.

Defined results: a null or empty text is one empty line; keys shorter than min_chars are never dropped; all lines of
one key within its smallest document stay; rows that repeat an id belong to one document; a null id is one document,
after all others; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, packed, stored, text_of, unpacked

MIN_CHARS = 10
#: A key is hot when it has more than this share of the sampled lines, and of a task's share of them if that is less; so there are at most 1000, or HOT_PARTS for each task.
HOT_SHARE, HOT_PARTS = 1 / 1000, 8
SAMPLED = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def key_of(line: Column) -> Column:
    """The line without white space at its ends, A to Z lower-cased (other letters keep their case)."""
    bare = F.btrim(line, F.lit(SPACE))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def line_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """h1, h2, id, text_hash, pos of every line whose key is long enough."""
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    rows = rows.withColumn("key", key_of(F.col("line"))).filter(F.char_length("key") >= min_chars)
    return rows.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"), "id", "text_hash", "pos")


def dropped_lines(lines: DataFrame) -> DataFrame:
    """id, text_hash, pos of the lines that go, from line_hashes() in a table."""
    tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = min(HOT_SHARE, 1 / (HOT_PARTS * tasks))
    some = lines.filter(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(SAMPLED)) == 0)
    total = some.agg(F.count(F.lit(1)).alias("n"))
    hot = some.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("c")).filter("c >= 16").join(F.broadcast(total), F.col("c") > F.col("n") * share)
    hot = hot.select(F.col("h1").alias("k1"), F.col("h2").alias("k2"))  # 1 / share rows at most
    same = (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2"))

    hot_lines = lines.join(F.broadcast(hot), same).drop("k1", "k2")
    first_of_hot = hot_lines.groupBy(F.col("h1").alias("k1"), F.col("h2").alias("k2")).agg(F.min("id").alias("first"))
    hot_gone = hot_lines.join(F.broadcast(first_of_hot), same).filter(~F.col("id").eqNullSafe(F.col("first")))

    cold = lines.join(F.broadcast(hot), same, "left_anti").repartitionByRange("h1", "h2")
    in_order = Window.partitionBy("h1", "h2").orderBy(F.col("id").asc_nulls_last(), "pos")
    cold_gone = cold.withColumn("first", F.first("id").over(in_order.rowsBetween(Window.unboundedPreceding, 0))).filter(~F.col("id").eqNullSafe(F.col("first")))
    columns = ["id", "text_hash", "pos"]
    return cold_gone.select(*columns).unionByName(hot_gone.select(*columns))


def bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """id, text_hash, gone: map from word number to 64 bits, bit k of word w set where line 64 w + k goes. Documents that keep all lines have no row."""
    gone = dropped_lines(stored(line_hashes(docs, id_col, text_col, min_chars), "line-hashes"))
    words = gone.groupBy("id", "text_hash", F.shiftright("pos", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos & 63)")).alias("bits"))
    return words.groupBy("id", "text_hash").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("gone"))


def with_lines(docs: DataFrame, maps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_row (the document), _lines (all its lines), _kept (those that its bitmap keeps).

    Texts move once, hashed by id; the bitmaps' side is the one held in memory, a partition at a time.
    """
    text = text_of(text_col)
    left = docs.select(packed(docs), F.col(id_col).alias("_id"), F.xxhash64(text).alias("_hash"), text.alias("_text"))
    right = maps.select(F.col("id").alias("_id2"), F.col("text_hash").alias("_hash2"), "gone")
    both = left.join(right.hint("shuffle_hash"), F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_hash") == F.col("_hash2")), "left")
    both = both.withColumn("_lines", F.split("_text", "\n", -1))
    last = F.shiftright(F.size("_lines") - 1, 6)
    dense = F.transform(F.sequence(F.lit(0), last), lambda w: F.coalesce(F.try_element_at(F.col("gone"), w), F.lit(0).cast("long")))
    both = both.withColumn("_words", F.when(F.col("gone").isNotNull(), dense))
    kept = F.expr("filter(_lines, (x, i) -> shiftright(_words[shiftright(i, 6)], i & 63) & 1L = 0L)")
    return both.withColumn("_kept", F.when(F.col("gone").isNull(), F.col("_lines")).otherwise(kept)).select("_row", "_lines", "_kept")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents with the text that their bitmaps keep; all other columns as they were, a null text stays null."""
    both = with_lines(docs, bitmaps(docs, id_col, text_col, min_chars), id_col, text_col)
    text = F.when(F.col("_row")[text_col].isNotNull(), F.array_join("_kept", "\n"))
    return unpacked(both, docs.columns, **{text_col: text})
