"""Benchmark decontamination: BM25 over test items with block-max WAND.

The items are indexed (terms, postings, impacts, and each block's largest impact), and every passage
of every text is a query: windows of two segments, each window begun one segment after the last, so an
item no longer than a segment lies whole in some window. Items stand on shelves by length, so that a
long item doesn't widen the windows of others: a segment is ``SEGMENT`` words, doubled until the item
fits. Impacts are multiples of the lowest score that a passage with 0.8 of the item's shingles can have
(:meth:`Item.least_share`), so one threshold, 1, serves all items and the retrieval drops no passage
that the verification would accept.

A text's windows are first held against the blocks' upper bounds, all at once; for those with a
block over the threshold, block-max WAND finds all items at or above it. These are verified: of the
item's five-word shingles the passage must hold 0.8, and the overlaps of question and of answer must
both reach ``PART_OVERLAP``. An item's answer follows its last "answer:", or else is its last third.

The index travels to the executors only up to ``INDEX_BYTES`` of item text; more items are dealt into
parts of about half of that. Document frequencies, the number of items and their mean length are those
of all items in every part, so the rows don't depend on the number of parts. The parts are held against
all passages one after another, and their results written, so the driver never holds more than one
part. Each part costs a scan of the texts: 100 MB of items are some 13.

Defined results: null and empty texts and items match nothing; items of fewer than five words match
as a whole sequence; items that repeat give rows of their own; repeated and null document ids are
kept; items with a null id are searched like others, and their rows have a null item id; whole-number
item ids are returned as longs, others in their own type; empty tables give no rows; other columns
are not read, and pass through :func:`drop_contaminated` unchanged; where the id's column is called
like a column of the result, the latter's name gets an underscore.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from crosspan.llm.common import fresh_name, text_of, written

WORD = re.compile(r"\w+")
K1, B = 1.2, 0.75
SEGMENT, ITEMS_PER_BLOCK, THRESHOLD = 64, 4, 1.0
SHINGLE, SIMILARITY, PART_OVERLAP = 5, 0.8, 0.5
INDEX_BYTES = 16 << 20
#: Sums and bounds that a slice of a text's windows may take at once.
CELLS = 1 << 22


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def shingles(words: list[str]) -> list[tuple[str, ...]]:
    """All runs of five words; of fewer words, the whole sequence."""
    n = min(SHINGLE, len(words))
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)] if n else []


class Item:
    """An item's words and its shingles, those of the question and those that end in the answer."""

    def __init__(self, key: object, text: str) -> None:
        self.key, self.words = key, words_of(text)
        at = text.lower().rfind("answer:")
        cut = len(words_of(text[: at + 7])) if at >= 0 else len(self.words) - len(self.words) // 3
        all_of = shingles(self.words)
        n = len(all_of[0]) if all_of else 0
        self.shingles = set(all_of)
        self.first = [s not in all_of[:i] for i, s in enumerate(all_of)] if len(self.shingles) < len(all_of) else [True] * len(all_of)
        self.run = n
        self.answer = {s for i, s in enumerate(all_of) if i + n > cut}
        self.question = {s for i, s in enumerate(all_of) if i + n <= cut}

    def overlaps(self, held: set[tuple[str, ...]]) -> tuple[float, float, float]:
        """Shares of the shingles, the question's and the answer's that ``held`` has."""
        share = lambda part: len(part & held) / len(part) if part else 1.0
        return len(self.shingles & held) / max(1, len(self.shingles)), share(self.question), share(self.answer)

    def least_share(self, shares: dict[str, float]) -> float:
        """The lowest sum of ``shares`` (by word) over passages with ``SIMILARITY`` of the shingles.

        A word that is missing takes with it all shingles around each of its places. The most that may
        go is found place by place: each place holds its part of its word's share, and a shingle counts
        where it first stands. So what a passage loses is never more than what is taken here.
        """
        total = len(self.shingles)
        spare = max(k for k in range(total) if (total - k) / total >= SIMILARITY)
        times: dict[str, int] = {}
        for w in self.words:
            times[w] = times.get(w, 0) + 1
        # lost[d, k]: the most that is lost with k shingles gone, where the last place lost is d back
        # (``run``: that far or further). The shingle that ends at a place goes if d < run.
        lost = np.full((self.run + 1, spare + 1), -np.inf)
        lost[self.run, 0] = 0.0
        for at, w in enumerate(self.words):
            start = at - self.run + 1
            cost = 1 if start >= 0 and self.first[start] else 0
            new = np.full_like(lost, -np.inf)
            gone = lost.max(axis=0) + shares[w] / times[w]
            new[0, cost:] = gone[: spare + 1 - cost]
            for d in range(1, self.run):
                new[d, cost:] = lost[d - 1, : spare + 1 - cost]
            new[self.run] = np.maximum(lost[self.run], lost[self.run - 1])
            lost = new
        return sum(shares[w] for w in times) - float(lost.max())


@dataclass
class Statistics:
    """What BM25 takes from all items: their number, mean length, and each term's document frequency."""

    items: int
    mean: float
    frequency: dict[str, int]

    @staticmethod
    def of(made: list[Item]) -> Statistics:
        frequency: dict[str, int] = {}
        for item in made:
            for w in set(item.words):
                frequency[w] = frequency.get(w, 0) + 1
        return Statistics(len(made), sum(len(x.words) for x in made) / max(1, len(made)), frequency)

    def impacts(self, item: Item) -> dict[str, float]:
        """The BM25 impact of each of the item's words."""
        norm = K1 * (1 - B + B * len(item.words) / self.mean)
        out = {}
        for w in item.words:
            out[w] = out.get(w, 0) + 1
        for w, f in out.items():
            n = self.frequency[w]
            out[w] = math.log1p((self.items - n + 0.5) / (n + 0.5)) * f * (K1 + 1) / (f + norm)
        return out


class Index:
    """Items on shelves by length, with common terms."""

    def __init__(self, items: list[tuple[object, str]], statistics: Statistics | None = None) -> None:
        made = [x for x in (Item(k, t) for k, t in items) if x.words]
        statistics = statistics or Statistics.of(made)
        self.terms: dict[str, int] = {}
        by_segment: dict[int, list[Item]] = {}
        for item in made:
            segment = SEGMENT
            while segment < len(item.words):
                segment *= 2
            by_segment.setdefault(segment, []).append(item)
        self.shelves = [Shelf(segment, by_segment[segment], self.terms, statistics) for segment in sorted(by_segment)]

    def search(self, text: str) -> list[tuple[object, float, float, float, float, int]]:
        """(item, score, overlap, question's, answer's, first word) of each verified item, its best passage."""
        words = words_of(text)
        get = self.terms.get
        terms = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        return [hit for shelf in self.shelves for hit in shelf.search(words, terms)]


class Shelf:
    """BM25 postings with block maxima; items are sorted by their words so that blocks are alike."""

    def __init__(self, segment: int, items: list[Item], terms: dict[str, int], statistics: Statistics) -> None:
        # Items that share their commonest words (and so their language) stand together.
        self.items = sorted(items, key=lambda x: (sorted(set(x.words), key=lambda w: (-statistics.frequency[w], w)), x.key is None, x.key))
        self.segment = segment
        self.blocks = -(-len(self.items) // ITEMS_PER_BLOCK)
        postings: dict[int, list[tuple[int, float]]] = {}
        self.least: list[float] = []
        for i, item in enumerate(self.items):
            impact = statistics.impacts(item)
            own = sum(impact.values()) or 1.0
            least = item.least_share({w: v / own for w, v in impact.items()})
            self.least.append(least)
            for w, v in impact.items():
                postings.setdefault(terms.setdefault(w, len(terms)), []).append((i, v / own / least))
        self.postings = [postings.get(t, []) for t in range(len(terms))]
        # Block maxima, by term: blocks and their largest impacts, one after another.
        starts, where, most = [0], [], []
        for posting in self.postings:
            best: dict[int, float] = {}
            for i, v in posting:
                best[i // ITEMS_PER_BLOCK] = max(best.get(i // ITEMS_PER_BLOCK, 0.0), v)
            where += best
            most += best.values()
            starts.append(len(where))
        self.starts, self.where, self.most = np.array(starts), np.array(where, np.int64), np.array(most)
        self.best = np.array([max((v for _, v in p), default=0.0) for p in self.postings])

    def promising(self, terms: np.ndarray) -> np.ndarray:
        """The windows (by first segment) in which some block's upper bound reaches the threshold."""
        at = np.flatnonzero((terms >= 0) & (terms < len(self.postings)))
        if not len(at) or not self.blocks:
            return np.empty(0, np.int64)
        # Each window's distinct terms: a word is in the window that begins with its segment, and in
        # the one before.
        segment, size = at // self.segment, len(self.postings)
        own = segment * size + terms[at]
        pairs = np.unique(np.concatenate([own, own[segment > 0] - size]))
        window, term = pairs // size, pairs % size
        n = self.starts[term + 1] - self.starts[term]
        # The windows go in slices, so that neither a long text nor a large index makes large arrays.
        windows = -(-len(terms) // self.segment)
        ends = np.searchsorted(window, np.arange(windows + 1))
        spent = np.cumsum(np.bincount(window, weights=n, minlength=windows) + self.blocks)
        lots = np.unique((spent // CELLS).astype(np.int64), return_index=True)[1].tolist()
        out = []
        for lo, hi in zip(lots, [*lots[1:], windows], strict=True):
            own = slice(ends[lo], ends[hi])
            starts, m = self.starts[term[own]], n[own]
            flat = np.repeat(starts - np.cumsum(m) + m, m) + np.arange(m.sum())
            key = np.repeat((window[own] - lo) * self.blocks, m) + self.where[flat]
            bound = np.bincount(key, weights=self.most[flat], minlength=(hi - lo) * self.blocks).reshape(hi - lo, self.blocks)
            out.append(lo + np.flatnonzero(bound.max(axis=1) >= THRESHOLD - 1e-9))
        return np.concatenate(out)

    def wand(self, terms: list[int]) -> list[tuple[int, float]]:
        """Items whose score against the distinct ``terms`` reaches the threshold, by block-max WAND."""
        lists = [(self.postings[t], self.best[t], self.starts[t], self.starts[t + 1]) for t in terms]
        cursor = [0] * len(lists)
        found = []
        while True:
            live = sorted((lists[k][0][cursor[k]][0], k) for k in range(len(lists)) if cursor[k] < len(lists[k][0]))
            total, pivot = 0.0, None
            for item, k in live:
                total += lists[k][1]
                if total >= THRESHOLD - 1e-9:
                    pivot = item
                    break
            if pivot is None:
                return found
            block = pivot // ITEMS_PER_BLOCK
            bound = 0.0
            for item, k in live:
                if item > pivot:
                    break
                lo, hi = lists[k][2], lists[k][3]
                j = lo + np.searchsorted(self.where[lo:hi], block)
                bound += self.most[j] if j < hi and self.where[j] == block else 0.0
            # Terms whose cursor is past the pivot but still in its block may add to other items only.
            if bound >= THRESHOLD - 1e-9:
                if live[0][0] == pivot:
                    score = 0.0
                    for item, k in live:
                        if item != pivot:
                            break
                        score += lists[k][0][cursor[k]][1]
                        cursor[k] += 1
                    if score >= THRESHOLD - 1e-9:
                        found.append((pivot, score))
                    continue
                goal = pivot
            else:
                # No item up to the next cursor, or the block's end, can reach the threshold.
                later = [item for item, _ in live if item > pivot]
                goal = min([(block + 1) * ITEMS_PER_BLOCK, *later[:1]])
            for item, k in live:
                if item >= goal:
                    break
                posting = lists[k][0]
                while cursor[k] < len(posting) and posting[cursor[k]][0] < goal:
                    cursor[k] += 1

    def search(self, words: list[str], terms: np.ndarray) -> list[tuple[object, float, float, float, float, int]]:
        """The shelf's verified items, each with its best passage."""
        best: dict[int, tuple[int, float, float, float, float, int]] = {}
        for segment in self.promising(terms).tolist():
            lo, hi = segment * self.segment, (segment + 2) * self.segment
            hits = self.wand(sorted({t for t in terms[lo:hi].tolist() if 0 <= t < len(self.postings)}))
            held = None
            for i, score in hits:
                item = self.items[i]
                if held is None:
                    held = {}
                n = min(SHINGLE, len(item.words))
                if n not in held:
                    passage = words[lo:hi]
                    held[n] = {tuple(passage[k : k + n]) for k in range(len(passage) - n + 1)}
                overlap, question, answer = item.overlaps(held[n])
                if overlap >= SIMILARITY and question >= PART_OVERLAP and answer >= PART_OVERLAP and (i not in best or overlap > best[i][2]):
                    best[i] = (item.key, score * self.least[i], overlap, question, answer, lo)
        return [best[i] for i in sorted(best)]


FOUND = ("item_id", "score", "overlap", "question_overlap", "answer_overlap", "first_word")
HITS = "array<struct<item_id:{},score:double,overlap:double,question_overlap:double,answer_overlap:double,first_word:long>>"


def item_parts(items: DataFrame, item_id: str, text_col: str, index_bytes: int) -> tuple[int, Iterator[tuple[list[tuple[object, str]], Statistics | None]]]:
    """The number of parts, and each part's items with the statistics of all; a part is what one index holds."""
    rows = items.select(items[item_id].cast(id_type(items, item_id)).alias("k"), text_of(items, text_col).alias("t"))
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    if total <= index_bytes:
        return 1, iter([([(r.k, r.t) for r in rows.collect()], None)])
    parts = 2 * -(-total // index_bytes)
    split = F.pandas_udf(lambda texts: texts.map(words_of), "array<string>")
    # Written once, since the numbers differ from run to run; rows that repeat go to all parts.
    dealt = written(rows.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts))).withColumn("words", split("t")), "items")
    size = dealt.where("size(words) > 0").agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean")).first()
    held = dealt.select("part", F.explode(F.array_distinct("words")).alias("term"))
    frequency = written(held.distinct().join(held.groupBy("term").agg(F.count("*").alias("n")), "term"), "frequency")

    def one(p: int) -> tuple[list[tuple[object, str]], Statistics]:
        mine = {r.term: r.n for r in frequency.where(F.col("part") == p).collect()}
        return [(r.k, r.t) for r in dealt.where(F.col("part") == p).select("k", "t").collect()], Statistics(size.n, size.mean or 1.0, mine)

    return parts, map(one, range(parts))


def id_type(items: DataFrame, item_id: str) -> str:
    """The type of the item ids in results."""
    kind = items.schema[item_id].dataType
    return "bigint" if isinstance(kind, IntegralType) else kind.simpleString()


def searching(part: tuple[list[tuple[object, str]], Statistics | None], kind: str):
    """A function of a text column that gives the verified items of each text."""

    @F.pandas_udf(HITS.format(kind))
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = Index(*part)
        for texts in batches:
            yield pd.Series([[dict(zip(FOUND, hit, strict=True)) for hit in index.search(t)] for t in texts])

    return find


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", index_bytes: int = INDEX_BYTES) -> DataFrame:
    """One row per document and item found in it: ids, score, overlaps, where the passage begins."""
    kind, out = id_type(items, item_id), None
    count, parts = item_parts(items, item_id, item_text, index_bytes)
    for part in parts:
        hits = docs.select(docs[id_col].alias(id_col), F.explode(searching(part, kind)(text_of(docs, text_col))).alias("h"))
        named = hits.select(id_col, *[F.col(f"h.{c}").alias(c + "_" if c.lower() == id_col.lower() else c) for c in FOUND])
        rows = named if count == 1 else written(named, "hits")
        out = rows if out is None else out.unionByName(rows)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", index_bytes: int = INDEX_BYTES) -> DataFrame:
    """``docs`` without those in which an item is found."""
    kind, found = id_type(items, item_id), None
    count, parts = item_parts(items, item_id, item_text, index_bytes)
    text = text_of(docs, text_col)
    for part in parts:
        if count == 1:
            return docs.where(F.size(searching(part, kind)(text)) == 0)
        # Items stand in texts, whatever the row: what goes is known by the digests of its texts.
        rows = docs.where(F.size(searching(part, kind)(text)) > 0).select(F.sha2(text.cast("binary"), 256).alias("gone"))
        rows = written(rows.distinct(), "found")
        found = rows if found is None else found.union(rows)
    name = fresh_name(docs, "text_sha256")
    keyed = docs.withColumn(name, F.sha2(text.cast("binary"), 256))
    found = found.distinct()
    return keyed.join(found, keyed[name] == found["gone"], "left_anti").drop(name)
