"""Mixing against SQL for sizes and targets, and the properties of what is taken."""

import duckdb
import pytest
from pyspark.sql import functions as F

from factlog.llm import mixing
from factlog.llm.queries import op10_mixing

SQL = r"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 1.0::DOUBLE + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS w
        FROM sized GROUP BY source),
lev AS (SELECT *, 3.0::DOUBLE * source_size / w AS full_at FROM src),
lev2 AS (SELECT *, (sum(source_size) OVER ()
          - coalesce(sum(3.0::DOUBLE * source_size) OVER (ORDER BY full_at, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY full_at, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS here FROM lev),
lev3 AS (SELECT *, arg_min(here, full_at) FILTER (WHERE here <= full_at) OVER () AS level FROM lev2)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, least(3.0::DOUBLE * source_size, level * w) AS target
FROM sized JOIN lev3 ON sized.source IS NOT DISTINCT FROM lev3.source
"""


def test_against_sql(spark, sf):
    got = op10_mixing(spark, sf).toPandas()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    both = got.merge(con.sql(SQL).df(), on="doc_id", suffixes=("", "_sql"))
    assert len(both) == len(got)
    assert (both["size"] == both.size_sql).all() and (both.source_size == both.source_size_sql).all()
    assert both.target.values == pytest.approx(both.target_sql.values)
    again = op10_mixing(spark, sf).toPandas()
    assert got.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()
    both = both.merge(con.sql("SELECT doc_id, source FROM documents").df(), on="doc_id")
    per = both.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), largest=("size", "max"))
    assert (abs(per.target - per.taken) <= per.largest / 2).all()
    assert (both.taken <= 3 * both["size"]).all()
    firsts = [p[0] for p in got.positions if len(p)]
    assert firsts == sorted(firsts) and 0 <= firsts[0] and firsts[-1] <= 1


def test_edges(spark):
    rows = [(1, "a b c", "x", 5), (1, "a b c", "x", 5), (2, None, "x", None), (3, "", None, 1), (4, "w " * 50, None, 1), (None, "q q", "y", 2), (5, "z", "x", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    out = mixing.curriculum(docs).toPandas()
    assert len(out) == len(rows)
    by_size = out.groupby("source_size").agg(target=("target", "first"))
    assert by_size.target.sum() == pytest.approx(59)
    assert (out.times <= 3).all() and (out[out["size"] == 0].times == 0).all()
    assert mixing.curriculum(docs.limit(0)).count() == 0
    order = mixing.mixed(docs)
    assert order.columns == docs.columns and order.count() == out.times.sum()


def test_full_source_is_reshared(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "a") for i in range(60)] + [(100, "w " * 10, "b"), (101, "w " * 10, "c")], "doc_id long, text string, source string")
    out = mixing.curriculum(docs).toPandas()
    small = out[out.id >= 100]
    assert (small.target == 30).all() and (small.times == 3).all()
    assert out[out.id < 100].target.iloc[0] == pytest.approx(560)


@pytest.mark.parametrize("knots", mixing.SCHEDULES)
def test_time_inverts_the_area(spark, knots):
    def area(t):
        done = 0.0
        for (a, x), (b, y) in zip(knots, knots[1:]):
            s = min(max(t - a, 0), b - a)
            done += x * s + (y - x) / (b - a) * s * s / 2
        return done

    for share, t in spark.range(101).select((F.col("id") / 100).alias("u"), mixing.time_of(F.col("id") / 100, knots)).collect():
        assert area(t) == pytest.approx(share * area(1.0), abs=1e-9)
