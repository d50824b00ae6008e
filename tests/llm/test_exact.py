"""Exact deduplication against plain comparison of texts."""

from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from crosspan.llm import exact


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def brute(rows):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    groups: dict[str, list] = {}
    for i, t in norm:
        groups.setdefault(t, []).append(i)
    out = []
    for t, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i))
        out += [(i, ids[0], len(ids), k == 0, hashlib.sha256(t.encode()).hexdigest()) for k, i in enumerate(ids)]
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


LONG = "".join(chr(97 + k * k % 26) for k in range(40_000))
ROWS = [
    (5, "a b"), (3, "a \t\n b"), (9, "a\x0b\x0cb"), (4, "a b"), (None, "a b"), (None, None), (2, ""), (1, " "), (8, " \r\n "), (7, LONG), (6, LONG), (10, LONG + "x"), (11, LONG[:-1]),
    (12, "ß漢" * 300), (13, "ß漢" * 300), (14, "x" * 512), (15, "x" * 1024), (16, "x" * 1023), (17, "x" * 513), (18, "\x00"), (19, "\x00\x00"), (3, "a b"), (3, "a b"), (20, "y"), (20, "z"),
]


def test_groups_equal_those_of_plain_comparison(spark):
    assert found(exact.exact_duplicates(frame(spark, ROWS).repartition(5))) == brute(ROWS)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64])
def test_any_block_size(spark, size):
    rows = [(k, ("ab" * (k % 5) + "c" * (k % 7))[: k % 17]) for k in range(120)] + [(500 + k, "ab" * k) for k in range(12)]
    assert found(exact.exact_duplicates(frame(spark, rows), size=size)) == brute(rows)


def test_names_that_share_their_address_take_another_seed(spark, monkeypatch):
    """A hash that is the same for every block under the first seeds costs time, never a wrong group."""
    real, tried = exact.address, []

    def poor(block, seed):
        tried.append(seed)
        return [F.lit(7).cast("long").alias("a"), F.lit(seed).cast("long").alias("b")] if seed < 2 else real(block, seed)

    monkeypatch.setattr(exact, "address", poor)
    assert found(exact.exact_duplicates(frame(spark, ROWS))) == brute(ROWS)
    assert set(tried) == {0, 1, 2}


def test_hot_text_and_hot_block(spark):
    rows = [(k, "same words in a third of all rows") for k in range(3000)] + [(5000 + k, "z" * 512 + str(k % 2000)) for k in range(4000)]
    assert found(exact.exact_duplicates(frame(spark, rows).repartition(7))) == brute(rows)


def test_dropping_keeps_columns_and_one_row(spark):
    docs = frame(spark, ROWS).withColumns({c: F.lit(f"clash {c}") for c in ("row", "id", "name", "level", "first", "a", "b", "at", "n", "t", "block", "keep_id", "sha")})
    kept = exact.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    want = sorted(((i, t) for i, _, _, k, t in brute(ROWS) if k), key=repr)
    assert sorted(((r.doc_id, hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "").encode()).hexdigest()) for r in kept.collect()), key=repr) == want
    assert found(exact.exact_duplicates(docs)) == brute(ROWS)


def test_empty_table_and_ids_of_other_kinds(spark):
    assert exact.exact_duplicates(frame(spark, [])).collect() == []
    assert exact.drop_exact_duplicates(frame(spark, [])).collect() == []
    docs = spark.createDataFrame([("b", "x"), ("a", "x "), (None, "x")], "row string, text string")
    out = exact.exact_duplicates(docs.withColumn("text", F.trim("text")), id="row")
    assert sorted(((r["row"], r.keep_id, r.group_size, r.kept) for r in out.collect()), key=repr) == [("a", "a", 3, True), ("b", "a", 3, False), (None, "a", 3, False)]


def test_the_plan_holds_no_python(spark):
    plan = exact.exact_duplicates(frame(spark, ROWS[:5]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
