"""Text in blocks, and an exchange of packed keys between blocks and buckets.

A corpus statistic over very many small keys (a byte context, a word, a 200-byte window) costs far
more as one row a key than as numbers. Here documents are first put together to blocks of a few
megabytes, in a table bucketed by block. A task takes one block, combines equal keys within it and
sends each *bucket* (a range of key hashes) one packed row; the bucket's task sees all blocks' keys
and answers each block in the same order; the answers join the block again without moving the text.

Equal keys are combined within a block, so a hot key costs a bucket one entry a block. Rows sent are
at most blocks times buckets, and never more than the blocks' distinct keys. Blocks grow with the input
(:func:`sized`), from 4 MB to at most 64 MB: 7,500 blocks of 4 MB at 30 GB, 1.6 million of 64 MB at
100 TB. A task holds one block or one bucket at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspan.llm.common import bucketed, text_of, written

#: The least and the largest block, and the number of blocks from which on they grow.
BLOCK_BYTES, LARGEST_BLOCK, MANY_BLOCKS = 4 << 20, 64 << 20, 1 << 14


def sized(docs: DataFrame, text_col: str, least: int = BLOCK_BYTES) -> int:
    """The block size for an input: ``least``, or more where that would make more than ``MANY_BLOCKS``."""
    total = docs.agg(F.sum(F.octet_length(text_of(docs, text_col)))).first()[0] or 0
    return max(least, min(LARGEST_BLOCK, total // MANY_BLOCKS))


def block_table(docs: DataFrame, id_col: str, text_col: str, block_bytes: int | None = None) -> DataFrame:
    """(block, ids, sizes, data): documents' UTF-8 bytes in blocks of about ``block_bytes``.

    Without ``block_bytes`` the input's size decides. A longer document is a block of its own. Documents keep the order in which they are read; the
    text isn't shuffled. The table is bucketed by block.
    """
    block_bytes = block_bytes or sized(docs, text_col)
    source = docs.select(docs[id_col].alias("id"), text_of(docs, text_col).cast("binary").alias("data"))
    kind = dict(source.dtypes)["id"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        ids, texts, held = [], [], 0

        def row() -> pa.RecordBatch:
            out = {
                "block": pa.array([(part << 32) | number], pa.int64()),
                "ids": pa.array([pa.concat_arrays(ids).to_pylist()], pa.list_(ids[0].type)),
                "sizes": pa.array([[len(t) for t in texts]], pa.list_(pa.int64())),
                "data": pa.array([b"".join(texts)], pa.binary()),
            }
            return pa.RecordBatch.from_pydict(out)

        for batch in batches:
            column, names = batch.column(1), batch.column(0)
            for i in range(batch.num_rows):
                text = column[i].as_py()
                if texts and held + len(text) > block_bytes:
                    yield row()
                    number, ids, texts, held = number + 1, [], [], 0
                ids.append(names.slice(i, 1))
                texts.append(text)
                held += len(text)
        if texts:
            yield row()

    packed = source.mapInArrow(pack, f"block long, ids array<{kind}>, sizes array<long>, data binary")
    return bucketed(packed, "block", "blocks")


def documents_of(block: dict) -> Iterator[tuple[int, object, bytes]]:
    """(position in the block, id, bytes) of its documents."""
    at = 0
    for i, (key, size) in enumerate(zip(block["ids"], block["sizes"], strict=True)):
        yield i, key, block["data"][at : at + size]
        at += size


Emit = Callable[[dict], Iterator[tuple[int, bytes]]]


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}


def answers_of(row: dict, name: str) -> dict[int, bytes]:
    """bucket -> answer, from a column that :func:`exchange` made."""
    return {a["bucket"]: a["data"] for a in row[name] or ()}


def exchange(source: DataFrame, emit: Emit, answer: Callable[[int, list[bytes], list[int]], tuple[list[bytes], int]], name: str) -> tuple[DataFrame, int]:
    """((block, name), total): the buckets' answers to each block, and the sum of their totals.

    ``emit`` gives a block's (bucket, payload) rows. ``answer`` takes a bucket, its payloads and
    their blocks, and gives one answer for each payload and a number to be summed.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            out = list(emit(row))
            for at in range(0, len(out), 64):
                part = out[at : at + 64]
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array([b for b, _ in part], pa.int32()),
                    "block": pa.array([row["block"]] * len(part), pa.int64()),
                    "data": pa.array([d for _, d in part], pa.binary()),
                })

    def reply(table: pa.Table) -> pa.Table:
        bucket, blocks = table["bucket"][0].as_py(), table["block"].to_pylist()
        made, total = answer(bucket, [x.as_buffer() for x in table["data"]], blocks)
        return pa.table({
            "block": pa.array(blocks, pa.int64()),
            "bucket": pa.array([bucket] * len(blocks), pa.int32()),
            "data": pa.array(made, pa.binary()),
            "total": pa.array([total] + [0] * (len(blocks) - 1), pa.int64()),
        })

    sent = source.mapInArrow(send, "bucket int, block long, data binary")
    replies = written(sent.groupBy("bucket").applyInArrow(reply, "block long, bucket int, data binary, total long"), name)
    total = replies.agg(F.sum("total")).first()[0] or 0
    return replies.groupBy("block").agg(F.collect_list(F.struct("bucket", "data")).alias(name)), total


def joined(blocks: DataFrame, *answers: DataFrame) -> DataFrame:
    """Blocks with the answers; only the answers are shuffled."""
    for a in answers:
        blocks = blocks.join(a.hint("shuffle_hash"), "block", "left")
    return blocks


def bucket_count(blocks: DataFrame) -> int:
    """As many buckets as there are blocks: both grow with the input."""
    return max(16, blocks.count())


def scaled(high: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each 64-bit hash, from its upper 32 bits, in order."""
    return ((high >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
