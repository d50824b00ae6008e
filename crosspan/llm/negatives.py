"""Hard negatives by candidate lists that clusters of anchors share.

An anchor's positives are its best rows of the same label; the hard negatives of such a pair are the
best rows of other labels whose score lies within a band below the positive's. Scores are integer
inner products of quantised vectors, so that they don't depend on the order of sums.

Anchors are clustered by direction. For a candidate c and a cluster with centre m and angle r around
its members, no member a scores more than ``|a| |c| cos(max(0, angle(c, m) - r))``. So candidates are
sorted once for a cluster, by ``|c| cos(...)``, and every member walks that list, passing over labels
that don't concern it, until no bound ahead reaches what it still needs: the result is exact.

Anchors come in rounds of about ``GROUP``, whose vectors, clusters and positives are broadcast; the
candidates stay where they are, and each task keeps the best few of an anchor for all its rows. Work
grows with anchors times candidates, less what the bounds cut off; what is shuffled is a few rows an
anchor and task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspan.llm.common import work_path, written

GROUP = 8_192  #: anchors of a round, about: 4 MB to broadcast at 64 dimensions
CLUSTER = 48  #: anchors of a cluster, on average
STRIDE = 1_024  #: most candidates that a walk looks at together
ROUNDS = 4  #: of moving the centres
SLACK = 1e-6  #: of a cosine, for rounding
NEVER = np.iinfo(np.int64).max


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: in doubles where they hold them, else as long or Python integers."""
    width = max(1, a.shape[1]) * float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0))
    if width < 2**52:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if width < 2**62:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    if any(not -(2**63) < x < NEVER for x in exact.ravel()):
        raise OverflowError("a score doesn't fit 64 bits")
    return exact.astype(np.int64)


def matrix(column: pa.Array, width: int = 0) -> np.ndarray:
    """Rows of a list column, short ones with zeros behind."""
    values, ends = np.asarray(column.flatten()), np.asarray(column.value_lengths())
    out = np.zeros((len(column), max(width, int(ends.max(initial=0)))), np.int64)
    out[np.arange(out.shape[1]) < ends[:, None]] = values
    return out


def widened(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


class Anchors:
    """The anchors of a round: vectors, lengths, and clusters by direction."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(rows)  # the clusters don't depend on how rows arrive
        self.rows, self.ids, self.labels, self.vectors = rows[order], ids[order], labels[order], vectors[order]
        self.lengths = np.sqrt((self.vectors.astype(float) ** 2).sum(axis=1))
        unit = self.vectors / np.maximum(self.lengths, 1e-300)[:, None]
        k = max(1, len(rows) // CLUSTER)
        self.centres = unit[np.random.default_rng(1).permutation(len(rows))[:k]]
        for _ in range(ROUNDS):
            own = (unit @ self.centres.T).argmax(axis=1)
            sums = np.zeros_like(self.centres)
            np.add.at(sums, own, unit)
            size = np.sqrt((sums**2).sum(axis=1))
            self.centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1e-300)[:, None], self.centres)
        self.own = (unit @ self.centres.T).argmax(axis=1)
        angles = np.arccos(np.clip((unit * self.centres[self.own]).sum(axis=1), -1, 1))
        self.angles = np.zeros(k)
        np.maximum.at(self.angles, self.own, angles)

    def bounds(self, vectors: np.ndarray) -> np.ndarray:
        """By cluster and candidate: what an anchor of length 1 can score at most."""
        lengths = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))
        width = max(vectors.shape[1], self.centres.shape[1])
        angles = np.arccos(np.clip(widened(self.centres, width) @ (widened(vectors, width) / np.maximum(lengths, 1e-300)[:, None]).T, -1, 1))
        return lengths * (np.cos(np.maximum(0, angles - self.angles[:, None])) + SLACK)


class Best:
    """The best few candidates for each of n searches: by score, then id, then row."""

    def __init__(self, n: int, size: int, floor: np.ndarray) -> None:
        self.size, self.floor = size, floor.copy()  # no score below its floor counts
        self.found: list[np.ndarray | None] = [None] * n

    def add(self, i: int, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        own = np.stack([score, ids, rows])
        if self.found[i] is not None:
            own = np.concatenate([self.found[i], own], axis=1)
        own = own[:, np.lexsort((own[2], own[1], -own[0]))[: self.size]]
        self.found[i] = own
        if own.shape[1] == self.size:
            self.floor[i] = own[0, -1]


def walk(anchors: Anchors, block: tuple[np.ndarray, ...], same: bool, best: Best, tops: np.ndarray) -> int:
    """Take a block of candidates (vectors, ids, labels, rows) into ``best``; the number of scores worked out.

    ``tops``: for each anchor and each of its searches (one, or one for a positive) the most that a
    score may be. ``same``: candidates have the anchor's label and aren't the anchor itself; else
    another label. Search i of anchor a is number ``a * tops.shape[1] + i`` of ``best``.
    """
    vectors, ids, labels, rows = block
    width, each, done = max(vectors.shape[1], anchors.vectors.shape[1]), tops.shape[1], 0
    vectors, own_vectors = widened(vectors, width), widened(anchors.vectors, width)
    bounds = anchors.bounds(vectors)
    for cluster in range(len(anchors.centres)):
        members = np.flatnonzero(anchors.own == cluster)
        order = np.argsort(-bounds[cluster], kind="stable")
        for label in np.unique(anchors.labels[members]):
            active, ahead = members[anchors.labels[members] == label], order[(labels[order] == label) == same]
            at, step = 0, 64
            while at < len(ahead):
                searches = active[:, None] * each + np.arange(each)
                # A search goes on while a bound ahead reaches its floor: an equal score may have a smaller id.
                needs = best.floor[searches].min(axis=1)
                active = active[anchors.lengths[active] * bounds[cluster][ahead[at]] >= needs]
                if not len(active):
                    break
                some = ahead[at : at + step]
                at, step = at + step, min(STRIDE, 2 * step)
                found = scores(own_vectors[active], vectors[some])
                done += found.size
                for j in range(each):
                    hit = (found <= tops[active, j][:, None]) & (found >= best.floor[active * each + j][:, None])
                    if same:
                        hit &= rows[some] != anchors.rows[active][:, None]
                    for i in np.flatnonzero(hit.any(axis=1)):
                        k = some[hit[i]]
                        best.add(active[i] * each + j, found[i][hit[i]], ids[k], rows[k])
    return done


def block_of(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    row, id, label, q = (batch.column(c) for c in ("row", "id", "label", "q"))
    return matrix(q), np.asarray(id), np.asarray(label), np.asarray(row)


def quantised(vectors: DataFrame, anchor: Column, id: str, vector: str, label: Column) -> DataFrame:
    """(row, id, label, q, is_anchor) of the rows that take part, q the floor of 256 times each component."""
    whole = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    picked = vectors.select(vectors[id].cast("long").alias("id"), label.cast("long").alias("label"), vectors[vector].cast("array<double>").alias("v"), F.coalesce(anchor, F.lit(False)).alias("is_anchor"))
    sound = picked.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", whole))
    return sound.select(F.monotonically_increasing_id().alias("row"), "id", "label", F.transform("v", lambda x: F.floor(256.0 * x)).alias("q"), "is_anchor")


def first_few(df: DataFrame, size: int, *keys: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "id", "row")
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= size)


def hard_negatives(
    vectors: DataFrame, anchor: Column, id: str = "vec_id", vector: str = "embedding", label: Column | None = None, positives: int = 5, negatives: int = 5,
    low: int = 80, high: int = 100, group: int = GROUP,
) -> DataFrame:
    """For each row with ``anchor`` and each of its positives: (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Rows take no part without an id, a label, or a vector of finite components. Vectors of unlike
    length count as if zeros followed; a zero vector scores 0. Equal scores go by the smaller id. Rows
    that share an id are rows of their own: each can be an anchor, and each other's positive. A pair
    with a negative score has no band, so no rows; a score beyond 64 bits raises. An empty table, or
    one without anchors, gives an empty one; other columns are neither read nor returned.
    """
    spark = vectors.sparkSession
    rows = written(quantised(vectors, anchor, id, vector, vectors["label"] if label is None else label), "vectors")
    starts = rows.where("is_anchor")
    n = starts.count()
    if not n:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    rounds = -(-n // group)
    out = work_path(spark, "negatives")
    for k in range(rounds):
        own = starts.where(F.pmod(F.xxhash64("row"), F.lit(rounds)) == k).toArrow().combine_chunks()
        if own.num_rows:
            columns = {c: own.column(c).combine_chunks() for c in ("row", "id", "label", "q")}
            of_round(rows, Anchors(*(np.asarray(columns[c]) for c in ("row", "id", "label")), matrix(columns["q"])), positives, negatives, low, high).write.parquet(f"{out}/round={k}")
    return spark.read.parquet(*[f"{out}/round={k}" for k in range(rounds)]) if rounds == 1 else spark.read.option("basePath", out).parquet(out).drop("round")


def of_round(rows: DataFrame, anchors: Anchors, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """The result for the anchors of a round."""
    spark, n = rows.sparkSession, len(anchors.rows)
    candidates = rows.select("row", "id", "label", "q")
    sent = spark.sparkContext.broadcast(anchors)

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, none = Best(n, positives, np.full(n, -NEVER)), np.full((n, 1), NEVER)
        for b in batches:
            walk(sent.value, block_of(b), True, best, none)
        for i, x in enumerate(best.found):
            if x is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(x.shape[1], i)), *map(pa.array, x)], ["anchor", "score", "id", "row"])

    pairs = first_few(candidates.mapInArrow(alike, "anchor long, score long, id long, row long"), positives, "anchor").select("anchor", "place", "score", "id").toArrow()
    # Scores and ids of an anchor's positives; where it has fewer, no score is low enough for a band.
    tops, partners = np.full((n, positives), -1), np.zeros((n, positives), np.int64)
    at = np.asarray(pairs.column("anchor")), np.asarray(pairs.column("place")) - 1
    tops[at], partners[at] = np.asarray(pairs.column("score")), np.asarray(pairs.column("id"))
    # In integers: low * positive <= 100 * negative <= high * positive.
    bands = [[(-(-low * int(p) // 100), high * int(p) // 100) if p >= 0 else (NEVER, -NEVER) for p in line] for line in tops]
    floors, ceilings = np.array([[b[0] for b in line] for line in bands]), np.array([[b[1] for b in line] for line in bands])
    told = spark.sparkContext.broadcast((floors, ceilings, tops, partners))

    def unlike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, (low_ends, high_ends, p_scores, p_ids) = sent.value, told.value
        best = Best(n * positives, negatives, low_ends.ravel())
        for b in batches:
            walk(own, block_of(b), False, best, high_ends)
        for i, x in enumerate(best.found):
            if x is not None:
                a, j = divmod(i, positives)
                heads = (i, own.ids[a], p_ids[a, j], p_scores[a, j])
                yield pa.RecordBatch.from_arrays([*(pa.array(np.full(x.shape[1], h)) for h in heads), *map(pa.array, x)], ["pair", "anchor_id", "positive_id", "positive_score", "score", "id", "row"])

    found = candidates.mapInArrow(unlike, "pair long, anchor_id long, positive_id long, positive_score long, score long, id long, row long")
    return first_few(found, negatives, "pair").select("anchor_id", "positive_id", F.col("place").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
