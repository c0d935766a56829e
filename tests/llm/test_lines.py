"""Line deduplication against a plain-Python version."""

import random

from factlog.llm import lines

SPACE = " \t\n\x0b\x0c\r"


def brute(rows):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))
    order = lambda i: (i is None, i)
    first = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            k = key(line)
            if len(k) >= 10 and (k not in first or order(i) < order(first[k])):
                first[k] = i
    return sorted(((i, None if text is None else "\n".join(x for x in text.split("\n") if len(key(x)) < 10 or first[key(x)] == i)) for i, text in rows), key=repr)


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, 1, "h") for i, t in rows], "doc_id long, text string, pos int, h1 string")
    out = lines.dedup_lines(docs)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == brute(rows)


def test_edges(spark):
    check(spark, [(3, "A line of text\nshort"), (1, "  a LINE of text\r\nshort\n"), (2, None), (4, ""), (None, "a line of text"), (5, "\u00c9a line of text\n\u00e9a line of text"), (1, "  a LINE of text\r\nshort\n"), (6, "x" * 100_000 + "\n\n" + "x" * 100_000), (7, "x" * 100_000), (8, "123456789"), (9, "123456789"), (9, "other words than before")])


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lines.dedup_lines(docs).count() == 0


def test_random(spark):
    rng = random.Random(1)
    pool = [f"line number {k} of the pool" for k in range(40)]
    check(spark, [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(200)))) for i in range(60)])


def test_hot_line(spark):
    check(spark, [(i, f"the common line\nline of {i} alone\nThe common line ") for i in range(800)])
