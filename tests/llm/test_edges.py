"""Every operator on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from crosspan.llm import arc, decontam, licenses, media, packing, ppm, repeats, secrets, simhash, toxicity

LONG = " ".join(f"word{i % 977} idiot token" for i in range(30_000))
ROWS = [(1, "Some words stand here and there."), (2, None), (3, ""), (4, "   \n\t "), (5, LONG), (6, "Some words stand here and there."), (6, "Some words stand here and there."), (None, "a text without id"), (7, "ß ürgendwas 漢字 \U0001f600 \x00 x"), (8, "éa" * 300)]
#: Columns that operators use inside or return; they must neither be read nor clash.
EXTRA = ("score", "block", "data", "ids", "spans", "fp", "id", "length", "rank", "salt", "held_out", "toxic_score", "component_id", "start")

OPERATORS = {
    "toxicity": lambda d: toxicity.score_toxicity(d, toxicity.Model(toxicity.fixed_lexicon())), "ppm": ppm.score_texts, "repeats": repeats.repeat_digests, "packing": packing.pack,
    "media": media.media_digests, "licenses": licenses.license_digests, "secrets": secrets.secret_digests, "simhash": simhash.near_duplicates,
}


def table(spark, rows=ROWS, extra=False):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit(f"clash {c}") for c in EXTRA}) if extra else df


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_a_document_whatever_it_holds(spark, name):
    out = OPERATORS[name](table(spark))
    if name == "packing":
        out = out.where("start = 0")
    assert sorted(map(repr, (r.doc_id for r in out.select("doc_id").collect()))) == sorted(repr(i) for i, _ in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_other_columns_do_not_matter(spark, name):
    drop = ("sequence_id", "offset")  # which of equal pieces goes where is free
    a, b = OPERATORS[name](table(spark)), OPERATORS[name](table(spark, extra=True))
    assert a.columns == b.columns
    assert collected(a.drop(*drop)) == collected(b.drop(*drop))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](table(spark, [])).collect() == []


@pytest.mark.parametrize("name", [n for n in OPERATORS if n != "packing"])
def test_partitions_do_not_matter(spark, name):
    assert collected(OPERATORS[name](table(spark).repartition(6))) == collected(OPERATORS[name](table(spark).coalesce(1)))


def test_null_is_the_empty_text(spark):
    digest = {r.doc_id: r.kept_sha256 for r in repeats.repeat_digests(table(spark)).where("doc_id in (2, 3)").collect()}
    assert digest == dict.fromkeys((2, 3), hashlib.sha256(b"").hexdigest())
    fp = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(table(spark)).where("doc_id in (2, 3, 4)").collect()}
    assert set(fp.values()) == {("0" * 16, 2)}


def test_filters_keep_columns_and_clean_rows(spark):
    docs = table(spark, extra=True)
    items = spark.createDataFrame([(1, None), (2, ""), (3, "entirely different question words with nothing in common at all")], "item_id long, text string")
    for out in (toxicity.drop_toxic(docs, toxicity.Model({})), decontam.drop_contaminated(docs, items), secrets.redact_secrets(docs)):
        assert out.columns == docs.columns and collected(out) == collected(docs)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(repr(r.doc_id) for r in kept.select("doc_id").collect()) == sorted(map(repr, [1, 2, 5, None, 7, 8]))


def test_one_row_of_each_group_where_ids_repeat(spark):
    a, b, c = ("first text with some words of its own", "another entirely different passage stands here", "a third one that nobody else has written")
    rows = [(3, a), (5, a), (5, b), (7, c), (7, c), (7, c), (9, c), (None, b), (None, b)]
    for docs in (table(spark, rows).repartition(4), table(spark, rows, extra=True)):
        kept = simhash.one_of_each(docs)
        assert kept.columns == docs.columns
        assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(3, a), (5, b), (7, c), (None, b), (None, b)], key=repr)


def test_warc_edges(spark):
    pages = [(3, "http://x/a b\n", "<p>ü</p>"), (1, None, None), (2, "u", ""), (4, "http://x", "<p>ü</p>"), (4, "http://x", "<p>ü</p>"), (None, "http://y", "<p>ü</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in arc.archived(df).collect()), key=repr)
    assert got == sorted([(1, 0, "response", None), (2, 0, "revisit", 1), (3, 9, "response", None), (4, 9, "revisit", 3), (4, 9, "revisit", 3), (None, 9, "revisit", 3)], key=repr)
    assert arc.archived(df.where("page_id > 9")).collect() == []


def test_decontamination_of_empty_tables(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    assert decontam.contaminated(table(spark, []), items).collect() == []
    assert decontam.contaminated(table(spark), items.where("item_id = 0")).collect() == []
