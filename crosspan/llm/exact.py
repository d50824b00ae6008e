"""Exact deduplication by block naming: equal texts get one integer identity, unequal ones never do.

A text is cut into blocks of ``BLOCK`` bytes. The distinct blocks of the corpus are dealt by their
hash, sorted by their bytes in each part, and named by part and place. Adjacent names form pairs, the
distinct pairs are sorted and named the same way, and so on until a text has one name; together with
the number of rounds that is its identity. Names come from bytes compared, not from a hash: 128 bits
only tell a text's block where its name stands, and since the dictionary holds every distinct block,
two blocks with the same 128 bits would be seen there; other seeds are taken then.

Everything is DataFrame work. Bytes are shuffled once, combined before; rows that share a block or a
text meet as counts, and the joins that hand names back are sort-merge joins whose hot keys Spark
splits. A text of n bytes takes log2(n / BLOCK) rounds, each with half the rows of the one before.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosspan.llm.common import fresh_name, text_of, written

BLOCK = 512
WHITE = r"[\x20\x09-\x0D]+"
MISSING = -1  #: stands for the right neighbour that a last, odd name lacks


def normalised(text: Column) -> Column:
    """Each run of white space as one space."""
    return F.regexp_replace(text, WHITE, " ")


def cut(data: Column, size: int, each) -> Column:
    """``each`` of the blocks of a binary column; the empty text is one empty block."""
    # The lambda holds the bytes, so that they are made once and not for every block.
    count = lambda b: F.greatest(F.lit(1), F.ceil(F.octet_length(b) / F.lit(size)).cast("int"))
    return F.transform(F.array(data), lambda b: F.transform(F.sequence(F.lit(0), count(b) - 1), lambda i: each(b.substr(i * size + 1, F.lit(size)))))[0]


def address(block: Column, seed: int) -> list[Column]:
    return [F.xxhash64(F.lit(2 * seed + k), block).alias("ab"[k]) for k in (0, 1)]


def ranked(df: DataFrame, *by: str) -> DataFrame:
    """``df``, whose rows are distinct and dealt already, with ``name``: its part and place in order of ``by``."""
    return df.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def block_names(texts: DataFrame, size: int, first_seed: int) -> tuple[DataFrame, int]:
    """(a, b, name) of all distinct blocks of ``texts``, and the seed under which no two share (a, b)."""
    blocks = texts.select(F.explode(cut(normalised(F.col("t")).cast("binary"), size, lambda b: b)).alias("block")).distinct()
    for seed in range(first_seed, first_seed + 8):
        names = written(ranked(blocks, "block").select(*address(F.col("block"), seed), "name"), "block_names")
        if names.groupBy("a", "b").count().where("count > 1").isEmpty():
            return names, seed
    raise RuntimeError("blocks share 128 bits under eight seeds")


def identities(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = BLOCK, first_seed: int = 0) -> DataFrame:
    """One row for each row of ``docs``: its id, a number ``row``, ``text_sha256``, and its identity (``level``, ``name``)."""
    texts = docs.select(docs[id].alias("id"), text_of(docs, text).alias("t"))
    names, seed = block_names(texts, size, first_seed)
    parts = F.transform(F.array(normalised(F.col("t"))), lambda t: F.struct(F.sha2(t.cast("binary"), 256).alias("sha"), cut(t.cast("binary"), size, lambda b: F.struct(*address(b, seed))).alias("blocks")))[0]
    rows = written(texts.select("id", F.monotonically_increasing_id().alias("row"), parts.alias("x")).select("id", "row", "x.sha", "x.blocks"), "texts")
    pairs = rows.select("row", F.size("blocks").alias("n"), F.posexplode("blocks").alias("at", "x")).select("row", "n", "at", "x.a", "x.b")
    most, level, done = rows.agg(F.max(F.size("blocks"))).first()[0] or 0, 0, []
    while True:
        named = written(pairs.join(names, ["a", "b"]).select("row", "n", "at", "name"), f"named_{level}")
        done.append(named.where("n = 1").select("row", F.lit(level).alias("level"), "name"))
        if most <= 1:
            break
        side = lambda k: F.coalesce(F.max(F.when(F.col("at") % 2 == k, F.col("name"))), F.lit(MISSING))
        pairs = named.where("n > 1").groupBy("row", F.expr("(n + 1) div 2").cast("int").alias("n"), F.expr("at div 2").cast("int").alias("at")).agg(side(0).alias("a"), side(1).alias("b"))
        # Written, so that both sides of the join are plain shuffles, of which Spark splits hot parts.
        names = written(ranked(pairs.select("a", "b").distinct(), "a", "b"), f"names_{level}")
        most, level = (most + 1) // 2, level + 1
    return rows.select("id", "row", "sha").join(reduce(DataFrame.unionAll, done), "row").select("id", "row", F.col("sha").alias("text_sha256"), "level", "name")


def groups(found: DataFrame) -> DataFrame:
    """``found`` of :func:`identities` with the ``first`` row of each group (id, then place; null ids last) and its ``group_size``."""
    firsts = found.groupBy("level", "name").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"), F.count("*").alias("group_size"))
    return found.join(written(firsts, "firsts"), ["level", "name"])  # written, as the names are


def exact_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = BLOCK) -> DataFrame:
    """Every row of ``docs`` with the id of the row that stays for its text, the group's size, and whether it stays.

    Null is the empty text. Of rows with one text and one id exactly one stays; a row without an id
    stays only where no row of its group has one. An empty table gives an empty one; other columns are
    neither read nor returned.
    """
    return groups(identities(docs, id, text, size)).select(
        F.col("id").alias(id), F.col("first.id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = BLOCK) -> DataFrame:
    """``docs`` with all columns, and one row of each text as in :func:`exact_duplicates`."""
    key = fresh_name(docs, "row")
    numbered = written(docs.withColumn(key, F.monotonically_increasing_id()), "numbered")
    # The id alone isn't unique: a struct of it and the row's number tells repeated rows apart.
    named = numbered.select(F.struct(F.col(id).isNull().alias("none"), F.col(id).alias("id"), F.col(key).alias("row")).alias("id"), F.col(text).alias("text"))
    kept = groups(identities(named, "id", "text", size)).where("row = first.row").select(F.col("id.row").alias(key))
    return numbered.join(kept, key, "left_semi").drop(key)
