"""Packing token sequences: shortest-pack-first over the length histogram.

Documents are tokenised once, cut into pieces of at most ``LENGTH`` ids, and the pieces' histogram of
lengths (at most ``LENGTH`` numbers, whatever the input) is packed on the driver. The packs are known
beforehand: as many of ``LENGTH`` ids as the ids fill, and one for each power of two in what is left,
so that nothing is padded. Lengths are placed longest first, in rounds: each time the shortest pack
(with the most room) takes a piece. Packs of an equal pattern are kept as one group with its count. A
piece that no pack has room for is cut, and its rest is placed in its turn. Groups are joined back to
the pieces by each piece's rank among those of its length; ranks come from counts by (length, salt), so
no length is gathered in one task.

A length or a rest splits at most one group, so groups are at most lengths plus rests, and places at
most groups times pieces of a pack; the table of places is broadcast up to ``MOST_PLACES`` rows, and
joined by chunks of ranks beyond that.

Defined results: null and empty texts are one piece with the closing id alone; repeated rows are
packed as often as they stand; null ids are packed like others; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import base64
import heapq
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspan.llm.common import text_of, written

LENGTH, END_ID, SALTS_PER, LEAST_SALTS = 2048, 1, 20_000, 64
MOST_PLACES, RANK_CHUNK = 200_000, 1 << 14
#: Texts of these characters alone take the fast way; for them a space always begins a new unit.
PLAIN = re.compile(r"[\n\x20-\x7e\xa1-ɏ]*")
DOUBLE = re.compile(r" [ \n]|\n ")
MOST_CACHED = 400_000


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Tokens:
    """Ids as the tokenizer file gives them, without special tokens added.

    The byte-pair merges never cross a unit of the tokenizer's splitting pattern, and in plain text
    a unit begins at each single space. So ids of " word" are looked up, and only new ones encoded.
    """

    def __init__(self, tokenizer: str, ranks: str) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.exact = Tokenizer.from_file(tokenizer)
        self.special = re.compile("|".join(re.escape(t.content) for t in self.exact.get_added_tokens_decoder().values()) or r"(?!)")
        self.known: dict[str, bytes] = {}

    def ids(self, text: str) -> np.ndarray:
        if self.special.search(text):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        if not PLAIN.fullmatch(text) or DOUBLE.search(text) or text.startswith(" "):
            return np.array(self.fast.encode_ordinary(text), np.uint32)
        head, *rest = text.split(" ")
        known = self.known
        out = [np.array(self.fast.encode_ordinary(head), np.uint32).tobytes()]
        try:
            out += [known[w] for w in rest]
        except KeyError:
            if len(known) > MOST_CACHED:
                known.clear()
            for w in rest:
                if w not in known:
                    known[w] = np.array(self.fast.encode_ordinary(" " + w), np.uint32).tobytes()
            out = out[:1] + [known[w] for w in rest]
        return np.frombuffer(b"".join(out), np.uint32)


def pieces(docs: DataFrame, id_col: str, text_col: str, length: int = LENGTH, tokenizer: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, ids): each document in pieces of at most ``length`` ids.

    ``ids`` are little-endian 32-bit numbers, null for a piece of ``length``, which is never cut again.
    """
    source = docs.select(docs[id_col].alias("id"), text_of(docs, text_col).alias("text"))
    kind = dict(source.dtypes)["id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(vocabulary_path(tokenizer), vocabulary_path(ranks))
        for batch in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            kept: list[bytes | None] = []
            for i, text in enumerate(batch.column(1)):
                ids = np.append(tokens.ids(text.as_py()), np.uint32(END_ID))
                for start in range(0, len(ids), length):
                    part = ids[start : start + length].astype("<u4").tobytes()
                    rows.append((i, start, len(part) // 4, zlib.crc32(part), len(ids)))
                    kept.append(part if len(part) < 4 * length else None)
            at, start, size, crc, total = (np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else [np.empty(0, np.int64)] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *map(pa.array, (start, size, crc, total)), pa.array(kept, pa.binary())], names=["id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return source.mapInArrow(cut, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, ids binary")


@dataclass(frozen=True)
class Place:
    """Where parts of equal pieces go: those of ``size`` ids with ranks from ``low`` to ``high``.

    The part of ``taken`` ids from ``at`` on stands at ``offset`` of the sequences from ``first`` on.
    """

    size: int
    low: int
    high: int
    at: int
    taken: int
    first: int
    offset: int


def pack_histogram(histogram: dict[int, int], length: int = LENGTH) -> list[Place]:
    """Places for all pieces of a histogram (length -> count); every id is in one, and none is padded."""
    total = sum(size * n for size, n in histogram.items())
    whole, rest = divmod(total, length)
    # Groups of packs with one pattern, the most room first: (-room, first pack, packs, capacity).
    groups = [(-length, 0, whole, length)] if whole else []
    for k in reversed(range(rest.bit_length())):
        if rest >> k & 1:
            groups.append((-(1 << k), whole, 1, 1 << k))
            whole += 1
    heapq.heapify(groups)
    # Pieces still to be placed, the longest first: (-ids, length of the piece, ids placed, low, high).
    todo = [(-size, size, 0, 0, n) for size, n in histogram.items() if n]
    heapq.heapify(todo)
    places = []
    while todo:
        left, size, at, low, high = heapq.heappop(todo)
        room, first, packs, capacity = heapq.heappop(groups)
        taken, n = min(-left, -room), min(packs, high - low)
        places.append(Place(size, low, low + n, at, taken, first, capacity + room))
        if n < packs:
            heapq.heappush(groups, (room, first + n, packs - n, capacity))
        if room + taken:
            heapq.heappush(groups, (room + taken, first, n, capacity))
        if low + n < high:
            heapq.heappush(todo, (left, size, at, low + n, high))
        if left + taken:
            heapq.heappush(todo, (left + taken, size, at + taken, low, low + n))
    return places


def padding(places: list[Place], length: int = LENGTH) -> int:
    """Ids of padding: to ``length``, but none after a power of two."""
    # Packs are filled from the front, so the ends of the last parts are the packs' sizes.
    ends: dict[int, int] = {}
    for p in places:
        for pack in range(p.first, p.first + p.high - p.low):
            ends[pack] = max(ends.get(pack, 0), p.offset + p.taken)
    return sum(length - end for end in ends.values() if end & (end - 1))


def ranked(cut: DataFrame, total: int) -> DataFrame:
    """``cut`` with each piece's ``rank`` among those of its length, from 0."""
    salts = max(LEAST_SALTS, total // SALTS_PER)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = counts.selectExpr("length", "salt", "sum(n) over (partition by length order by salt) - n as before")
    own = salted.selectExpr("*", "row_number() over (partition by length, salt order by id, start, ids_crc32) - 1 as own")
    return own.join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("own")).drop("salt", "own", "before")


def placed(pieces_ranked: DataFrame, places: list[Place], most_places: int = MOST_PLACES) -> DataFrame:
    """Each piece with the places of its parts; a piece that isn't cut has one."""
    spark = pieces_ranked.sparkSession
    rows = [(p.size, p.low, p.high, p.at, p.taken, p.first, p.offset) for p in places] or [(0, 0, 0, 0, 0, 0, 0)]
    table = spark.createDataFrame(rows, "size long, low long, high long, at long, taken long, first long, offset long")
    here = (F.col("length") == F.col("size")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    if len(rows) <= most_places:
        return pieces_ranked.join(F.broadcast(table), here)
    chunks = table.withColumn("chunk", F.explode(F.sequence(F.expr(f"low div {RANK_CHUNK}"), F.expr(f"(high - 1) div {RANK_CHUNK}"))))
    mine = pieces_ranked.withColumn("own_chunk", F.expr(f"rank div {RANK_CHUNK}"))
    return mine.join(chunks.hint("shuffle_merge"), here & (F.col("chunk") == F.col("own_chunk")))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, most_places: int = MOST_PLACES, **files: str) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    cut = written(pieces(docs, id_col, text_col, length, **files), "pieces")
    # At most ``length`` rows.
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    parts = placed(ranked(cut, sum(histogram.values())), pack_histogram(histogram, length), most_places)
    own = F.crc32(F.expr("substring(ids, cast(4 * at + 1 as int), cast(4 * taken as int))"))
    return parts.select(
        F.col("id").alias(id_col), (F.col("start") + F.col("at")).alias("start"), F.col("taken").alias("length"),
        F.when(F.col("taken") < F.col("length"), own).otherwise(F.col("ids_crc32")).alias("ids_crc32"), "doc_tokens",
        (F.col("first") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset",
    )
