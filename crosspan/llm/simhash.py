"""SimHash near-duplicates by a self-join of binary tries.

A document's 64-bit fingerprint is the bitwise majority over the XXH64 values of its three-word
shingles. Two fingerprints link if they differ in at most two bits. Equal fingerprints collapse
first, so a group of copies is one fingerprint however large it is.

Of three pieces of the 64 bits, two fingerprints that link agree in one; of three pieces of the
other bits they agree in one again. Every fingerprint goes to the nine subtries that these two
pieces name (about 35 bits of common prefix, after the bits are put in that order). In each, the trie
over the rest is joined with itself: pairs of nodes are walked together, adding up the bits in which
they differ, and a pair is left as soon as it has more than two. A subtrie of more than
``MOST_MEMBERS`` fingerprints is split by further bits into nodes, and each pair of nodes that differ
in at most two of these bits becomes a join of its own. Within a join only the links that join two
parts are kept (a spanning forest), which loses no link between different components.

Components come from alternating large-star and small-star steps on the remaining links, each step
written to the shared folder.

:func:`one_of_each`, which filters a corpus, asks for a similarity of 0.8 on five-word shingles. Such
texts differ in ``UNLIKE`` of the bits (77 of 512, give or take 8), so it takes a signature of 512 bits and
a budget of ``WIDE_BUDGET``, which 0.97 of pairs at the limit keep. The method is the same: exact names send
signatures to subtries, which are joined with themselves, pairs of nodes walked together until they differ
in more than the budget. No pair within the budget is lost, whatever its bits are: of several pieces of the 512
bits, whose shares add up to the budget and one, two such signatures differ in fewer bits than its share in
at least one. A piece of share s gives each of its bits a column of s binary digits. It has a name for
each of the 2^s - 1 vectors that aren't zero, which keeps the bits, about half, whose column has an odd product with
it. Fewer than s columns leave a vector that is orthogonal to them all, so one name keeps none of the bits that
differ, and its subtrie has both. There are some 2,000 names for 2 * 10^5 signatures: :func:`names_for`
weighs more names against larger subtries. They are made within a task, which has at most some ``MOST_NAMED``
signatures, so that memory is bounded. Of more, any two meet in one task (:func:`exact_links`): a signature is sent
to a task more than there are times ``MOST_NAMED`` of them (to half of ``SLICES`` if all fit), and the work grows with the square of these times.

:func:`similar_links` takes a ``recall`` below 1, too, which :func:`one_of_each` doesn't ask for: then each of
several tables names subtries of about ``SUBTRIE`` signatures by bits of its own, and there are as many tables as share
a pair at the limit with that probability; the other pairs are lost.

Defined results: texts without words (null, empty, blank) have fingerprint zero and link like any
other; with fewer words than a shingle the whole sequence is the shingle; repeated rows each give a
row; rows with a null id take part in the links but name no component unless they are alone (then the
component is null); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspan.llm.common import fresh_name, text_of, written

BITS, WORDS, SEED, DISTANCE = 64, 3, 42, 2
#: The three pieces of the 64 bits, from the most significant: (shift, width).
PIECES = ((43, 21), (22, 21), (0, 22))
#: The most members of one join (or of each side of it).
MOST_MEMBERS = 4096
#: Rows of one component that one task joins, and the most larger components whose names are broadcast.
PER_TASK, MOST_LARGE = 1000, 100_000
#: The signature of :func:`one_of_each`: bits, words, the most bits that may differ (those that a similarity of 0.8
#: leaves unlike, and two standard deviations of 8 more); of tables, members of a subtrie, and the share of pairs that share one.
WIDE, WIDE_WORDS, WIDE_BUDGET, UNLIKE, SUBTRIE, RECALL = 512, 5, 92, 0.15, 512, 0.99
#: The most signatures of one walk without names, of one task with names, of a subtrie whose pairs are looked at one by
#: one, and how many tasks share the names where lines are few (half as many for one line).
MOST_WALKED, MOST_NAMED, FEW, SLICES = 2048, 1 << 19, 64, 16
#: Nanoseconds to put a signature into a name's subtrie, and to look at a pair.
NAMING, LOOKING = 60, 150


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of the shingles of ``words`` words; of fewer words, of the whole sequence."""
    import xxhash

    tokens = text.encode().lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(tokens) < words:
        return np.array([digest(b" ".join(tokens), SEED)], np.uint64)
    return np.array([digest(b" ".join(s), SEED) for s in zip(*(tokens[i:] for i in range(words)), strict=False)], np.uint64)


def majority(h: np.ndarray) -> int:
    """The bits that more than half of the numbers have."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 4096):  # the sums of a slice fit 16 bits
        part = np.unpackbits(h[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += part.sum(axis=0, dtype=np.uint16)
    return int.from_bytes(np.packbits(counts * 2 > len(h)).tobytes(), "big")


def fingerprint_of(text: str, words: int = WORDS) -> int:
    """Majority of the bits of the shingles' XXH64; ties and no shingles give 0 bits."""
    return majority(shingle_hashes(text, words))


def signature_of(text: str) -> list[int]:
    """The 512 bits of five-word shingles: eight numbers, each from one mix of the shingles' XXH64."""
    h = shingle_hashes(text, WIDE_WORDS)
    out = []
    for k in range(WIDE // BITS):
        x = h + np.uint64((k * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(majority(x ^ (x >> np.uint64(31))))
    return out


def fingerprinting():
    """A function of a text column that gives the fingerprint as a signed 64-bit number."""

    @F.pandas_udf("long")
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint_of(t) for t in texts], np.uint64).view(np.int64))

    return fp


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint as a signed 64-bit number."""
    return docs.select(docs[id_col].alias("id"), fingerprinting()(text_of(docs, text_col)).alias("fp"))


def _subtries(fp: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each of the nine prefixes: its number, the prefix's bits, and the bits that remain."""
    for i, (shift, width) in enumerate(PIECES):
        head = (fp >> np.uint64(shift)) & np.uint64((1 << width) - 1)
        low = fp & np.uint64((1 << shift) - 1)
        rest = ((fp >> np.uint64(shift + width)) << np.uint64(shift) if shift + width < BITS else np.zeros_like(fp)) | low
        left = BITS - width
        third = left // 3
        for j, (at, wide) in enumerate(((left - third, third), (left - 2 * third, third), (0, left - 2 * third))):
            part = (rest >> np.uint64(at)) & np.uint64((1 << wide) - 1)
            under = rest & np.uint64((1 << at) - 1)
            over = (rest >> np.uint64(at + wide)) << np.uint64(at) if at + wide < left else np.zeros_like(rest)
            yield 3 * i + j, (head << np.uint64(wide)) | part, over | under


def trie_links(rest: np.ndarray, other: np.ndarray | None = None, budget: int = DISTANCE) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of values that differ in at most ``budget`` bits.

    The pairs are those of (distinct) ``rest`` with itself, or with ``other``. The sorted values are the
    trie: a node is a range of them and a depth. Pairs of nodes start with the roots, and carry the bits in
    which they differ so far.
    """
    if not len(rest) or (other is not None and not len(other)):
        return []
    order = np.argsort(rest, kind="stable")
    values = rest[order].tolist()
    count, first = len(values), 0
    if other is not None:
        second = np.argsort(other, kind="stable")
        first, values = count, values + other[second].tolist()
        order = np.concatenate([order, second])
    parent = list(range(len(values)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def cut(lo: int, hi: int, bit: int) -> int:
        """The first of the range whose ``bit`` is set."""
        while lo < hi:
            mid = (lo + hi) // 2
            if values[mid] >> bit & 1:
                hi = mid
            else:
                lo = mid + 1
        return lo

    links = []
    top = max(max(values[0], values[count - 1], values[first], values[-1]), 1).bit_length() - 1
    stack = [(0, count, first, len(values), top, 0)] if len(values) > 1 else []
    while stack:
        a, b, c, d, bit, spent = stack.pop()
        if b - a == 1 and d - c == 1:
            if a != c and spent + (((values[a] ^ values[c]) & ((1 << (bit + 1)) - 1)).bit_count()) <= budget:
                x, y = root(a), root(c)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    links.append((int(order[a]), int(order[c])))
            continue
        if bit < 0:
            continue  # values are distinct on each side, so no range is left wider
        m = cut(a, b, bit)
        if (a, b) == (c, d):
            pairs = ((a, m, a, m, 0), (m, b, m, b, 0), (a, m, m, b, 1))
        else:
            n = cut(c, d, bit)
            pairs = ((a, m, c, n, 0), (m, b, n, d, 0), (a, m, n, d, 1), (m, b, c, n, 1))
        for p, q, r, s, more in pairs:
            if p < q and r < s and spent + more <= budget and not (p == r and q - p == 1):
                stack.append((p, q, r, s, bit - 1, spent + more))
    return links


def links(distinct: DataFrame, most_members: int = MOST_MEMBERS) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp), spanning every component."""

    def spread(batches):
        for pdf in batches:
            fp = pdf["fp"].to_numpy(np.int64).view(np.uint64)
            for k, prefix, rest in _subtries(fp):
                yield pd.DataFrame({"k": np.full(len(fp), k, np.int32), "prefix": prefix.view(np.int64), "fp": fp.view(np.int64), "rest": rest.view(np.int64)})

    keyed = distinct.select("fp").mapInPandas(spread, "k int, prefix long, fp long, rest long")

    keyed = keyed.withColumn("node", F.lit(0).cast("long")).withColumn("side", F.lit(0).cast("long"))
    large = keyed.groupBy("k", "prefix").count().where(F.col("count") > most_members)
    large = written(large.select("k", "prefix", F.ceil(F.log2(F.col("count") / most_members)).cast("int").alias("more")), "large")
    if not large.isEmpty():
        # Nodes by so many further bits; a join of two nodes is named by both, and sides say whose a member is.
        wide = keyed.drop("node", "side").join(large, ["k", "prefix"])
        other = F.explode(F.expr("filter(sequence(0L, shiftleft(1L, more) - 1), x -> bit_count(x) <= 2)"))
        # At most 29 bits remain, the lower ones of ``rest``.
        wide = wide.withColumn("own", F.expr("shiftrightunsigned(rest, 29 - more)")).withColumn("change", other)
        wide = wide.withColumn("with", F.col("own").bitwiseXOR(F.col("change")))
        wide = wide.select("k", "prefix", "fp", "rest", (F.least("own", "with") * (1 << 32) + F.greatest("own", "with")).alias("node"), (F.col("own") > F.col("with")).cast("long").alias("side"))
        keyed = keyed.join(large, ["k", "prefix"], "left_anti").unionByName(wide)
    groups = keyed.groupBy("k", "prefix", "node").agg(F.collect_list("fp").alias("fp"), F.collect_list("rest").alias("rest"), F.collect_list("side").alias("side")).where(F.size("fp") > 1)

    def join(batches):
        for pdf in batches:
            out = []
            for fp, rest, side in zip(pdf["fp"], pdf["rest"], pdf["side"], strict=True):
                rest, side = np.array(rest, np.int64).view(np.uint64), np.array(side)
                if side.any():
                    a, b = np.flatnonzero(side == 0), np.flatnonzero(side)
                    out += [(fp[a[i]], fp[b[j]]) for i, j in trie_links(rest[a], rest[b])]
                else:
                    out += [(fp[i], fp[j]) for i, j in trie_links(rest)]
            yield pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return groups.select("fp", "rest", "side").mapInPandas(join, "a long, b long")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the least node of the component, for every node in ``edges`` (a, b).

    Large-star links each node's larger neighbours to its least neighbour, small-star its smaller
    ones; the two in turn shrink every component to a star.
    """
    pairs = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    for _ in range(max_rounds):
        both = pairs.select("u", "v").union(pairs.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        new = written(small, "links")
        kind = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        done = kind(new) == kind(pairs)
        pairs = new
        if done:
            break
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    roots = pairs.select("v").distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("v", "v"))


def by_root(roots: DataFrame, value) -> DataFrame:
    """``roots`` with an aggregate of their component in the column ``named``.

    Components of more than ``PER_TASK`` rows, of which there can be one in so many rows, aren't dealt
    out by their root: their names are sent to all, up to ``MOST_LARGE``.
    """
    named = written(roots.groupBy("root").agg(value.alias("named"), F.count("*").alias("n")), "named")
    large = named.where(F.col("n") > PER_TASK).select("root", "named")
    if not 0 < large.count() <= MOST_LARGE:
        return roots.join(named.select("root", "named"), "root")
    large = F.broadcast(large)
    rest = roots.join(large, "root", "left_anti").join(named.where(F.col("n") <= PER_TASK).select("root", "named"), "root")
    return rest.unionByName(roots.join(large, "root"))


def rooted(fps: DataFrame) -> DataFrame:
    """(fp, least, root) of the distinct fingerprints: their least id, and what names the component."""
    distinct = written(fps.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    found = components(links(distinct))
    return written(distinct.join(found, distinct.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, ``fingerprint`` (16 hex digits) and ``component_id``.

    ``component_id`` is the least id reachable over links, the document's own included.
    """
    fps = written(fingerprints(docs, id_col, text_col), "fingerprints")
    roots = rooted(fps)
    named = by_root(roots, F.min("least")).select("fp", F.col("named").alias("component_id"))
    return fps.join(named, "fp").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def tables_for(distinct: int, recall: float = RECALL) -> list[list[int]]:
    """The bits that name a subtrie, table by table, for so many distinct signatures.

    A single table without such bits, whose one trie has all pairs, if ``recall`` is 1 or if it is less work.
    """
    width = max(4, math.ceil(math.log2(max(2, distinct) / SUBTRIE)))
    count = 1 if recall >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - (1 - UNLIKE) ** width))
    if recall >= 1 or distinct <= SUBTRIE * count:
        return [[]]
    return [sorted(np.random.default_rng(t).permutation(WIDE)[:width].tolist()) for t in range(count)]


class Trie:
    """The binary trie over distinct signatures (n x 8), without nodes of one child.

    Nodes are numbered: the leaves first, in the order of the sorted signatures, then the others. Each has a
    depth (the bits that all below it share), a row of ``order`` that lies below it, and two children.
    """

    def __init__(self, sig: np.ndarray):
        n = len(sig)
        self.order = np.lexsort(sig.T[::-1])
        rows = sig[self.order]
        bits = np.unpackbits((rows[1:] ^ rows[:-1]).astype(">u8").view(np.uint8).reshape(n - 1, 8 * sig.shape[1]), axis=1)
        shared = bits.argmax(axis=1)
        self.depth = np.concatenate([np.full(n, sig.shape[1] * BITS), shared]).astype(np.int32)
        self.row = np.concatenate([np.arange(n), np.arange(n - 1)]).astype(np.int32)
        low, high = [-1] * (2 * n - 1), [-1] * (2 * n - 1)
        # Nodes that may still grow, from the root down; neighbours that share fewer bits end the deeper ones.
        path: list[tuple[int, int]] = []
        for i, d in enumerate(shared.tolist()):
            last = i
            while path and path[-1][1] > d:
                top, _ = path.pop()
                high[top] = last
                last = top
            low[n + i] = last
            path.append((n + i, d))
        last = n - 1
        while path:
            top, _ = path.pop()
            high[top] = last
            last = top
        self.root, self.low, self.high = last, np.array(low, np.int32), np.array(high, np.int32)


def wide_trie_links(sig: np.ndarray, other: np.ndarray | None = None, budget: int = WIDE_BUDGET, most: int = 1 << 15) -> list[tuple[int, int]]:
    """:func:`trie_links` for signatures (n x 8): a spanning forest of the pairs that differ in at most ``budget`` bits.

    Pairs of nodes are walked together from the roots, up to ``most`` at a time. A pair is left as soon as the bits
    that both nodes have differ in more than ``budget``; else the less deep one gives way to its children.
    """
    if not len(sig) or (other is not None and not len(other)):
        return []
    one = Trie(sig)
    low, high, depth, row, order, start = one.low, one.high, one.depth, one.row, one.order, (one.root, one.root)
    values = sig[order]
    if other is not None:
        two, nodes = Trie(other), np.int32(len(one.depth))
        low, high = np.concatenate([low, np.where(two.low < 0, -1, two.low + nodes)]), np.concatenate([high, np.where(two.high < 0, -1, two.high + nodes)])
        depth, row = np.concatenate([depth, two.depth]), np.concatenate([row, two.row + np.int32(len(sig))])
        order, start = np.concatenate([order, two.order + len(sig)]), (one.root, two.root + nodes)
        values = np.concatenate([values, other[two.order]])
    words, full = [np.ascontiguousarray(w) for w in values.T], values.shape[1] * BITS
    label, links = np.arange(len(order)), []

    def near(x: np.ndarray, y: np.ndarray, until: np.ndarray | None) -> np.ndarray:
        """The pairs of rows that differ in at most ``budget`` of the first ``until`` bits, or of all."""
        at, spent = np.arange(len(x)), np.zeros(len(x), np.int64)
        for k, word in enumerate(words):
            unlike = word[x[at]] ^ word[y[at]]
            if until is not None:
                beyond = np.clip((k + 1) * BITS - until[at], 0, BITS)
                unlike = np.where(beyond < BITS, unlike >> np.minimum(beyond, BITS - 1).astype(np.uint64), np.uint64(0))
            spent += np.bitwise_count(unlike)
            if (k + 1) * BITS > budget:
                kept = spent <= budget
                at, spent = at[kept], spent[kept]
        return at

    todo = [(np.array(start[:1], np.int32), np.array(start[1:], np.int32))]
    while todo:
        x, y = todo.pop()
        if len(x) > most:
            todo.append((x[most:], y[most:]))
            x, y = x[:most], y[:most]
        same = x == y
        own = x[same]
        own = own[low[own] >= 0]
        x, y = x[~same], y[~same]
        whole = np.minimum(depth[x], depth[y])
        leaves = whole == full
        i, j = row[x[leaves]], row[y[leaves]]
        i, j = (side[near(i, j, None)] for side in (i, j))
        # Only links that join two parts are kept.
        apart = label[i] != label[j]
        for a, b in zip(i[apart].tolist(), j[apart].tolist(), strict=True):
            if label[a] != label[b]:
                links.append((int(order[a]), int(order[b])))
                label[label == label[b]] = label[a]
        x, y, whole = x[~leaves], y[~leaves], whole[~leaves]
        deep = np.flatnonzero(whole > budget)  # fewer bits can't differ in more
        if len(deep):
            left = np.ones(len(x), bool)
            left[deep[near(row[x[deep]], row[y[deep]], whole[deep])]] = False
            left[whole <= budget] = False
            x, y = x[~left], y[~left]
        turn = depth[x] > depth[y]
        x, y = np.where(turn, y, x), np.where(turn, x, y)
        x, y = np.concatenate([low[own], high[own], low[own], low[x], high[x]]), np.concatenate([low[own], high[own], high[own], y, y])
        if len(x):
            todo.append((x, y))
    return links


@functools.cache
def kept_bits(width: int, share: int) -> tuple[int, ...]:
    """The bits (as masks) that the names of a piece of ``width`` bits keep; any fewer than ``share`` bits are kept by none of them in one.

    The columns are changed one by one as long as that leaves unlike signatures fewer names in common.
    """
    vectors = np.arange(1, 1 << share)
    odd = (np.bitwise_count(vectors[:, None] & vectors[None]) & 1).astype(np.int64)
    column = np.random.default_rng(width).integers(0, len(vectors), width)
    kept, unlike, before = odd[:, column].sum(axis=1), 1 - odd / 2, math.inf
    while (now := (0.5**kept).sum()) < before:
        before = now
        for k in range(width):
            kept -= odd[:, column[k]]
            column[k] = np.argmin(0.5**kept @ unlike)
            kept += odd[:, column[k]]
    return tuple(sum(1 << k for k in np.flatnonzero(row).tolist()) for row in odd[:, column])


def pieces_of(count: int) -> list[tuple[int, int, int]]:
    """The bits in ``count`` pieces: first bit, width, share. The shares add up to ``WIDE_BUDGET`` and one."""
    ends = [WIDE * k // count for k in range(count + 1)]
    share, more = divmod(WIDE_BUDGET + 1, count)
    wide = sorted(range(count), key=lambda k: ends[k] - ends[k + 1])[:more]
    return [(ends[k], ends[k + 1] - ends[k], share + (k in wide)) for k in range(count)]


def names_for(members: int) -> list[tuple[int, int, int]]:
    """The names of so many signatures' subtries: a piece's first bit and width, and the bits of it that the name keeps.

    Of so many pieces that naming, and looking at pairs of unlike signatures, take the least time.
    """

    def cost(count: int) -> float:
        names = sum((1 << share) - 1 for _, _, share in pieces_of(count))
        return names * (NAMING * members + LOOKING * members**2 * 2.0 ** (-WIDE / count / 2))

    return [(at, width, kept) for at, width, share in pieces_of(min(range(10, 33), key=cost)) for kept in kept_bits(width, share)]


def named_links(sig: np.ndarray, names: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of distinct signatures (n x 8) that share one of ``names`` and differ within the budget.

    Subtries of more than ``FEW`` are joined by :func:`wide_trie_links`; in smaller ones only the leaves are compared.
    Pairs that are joined already are left.
    """
    n = len(sig)
    # The first half of the bits tells nearly all pairs of unlike signatures; its words lie together for each row.
    halves = [np.ascontiguousarray(half) for half in np.split(sig, 2, axis=1)]
    label, links = np.arange(n), []
    rows, own = np.arange(n, dtype=np.uint64), np.uint64((1 << max(n - 1, 1).bit_length()) - 1)

    def root(x: int) -> int:
        while label[x] != x:
            x = int(label[x])
        return x

    def join(i: np.ndarray, j: np.ndarray, looked: bool = False) -> None:
        """Takes the links among the pairs of rows that aren't joined yet; ``looked``: all of them are links."""
        for at in range(0, len(i), 1 << 13):  # few enough that memory is used again
            x, y = i[at : at + (1 << 13)], j[at : at + (1 << 13)]
            apart = label[x] != label[y]
            x, y = x[apart], y[apart]
            spent = np.zeros(len(x), np.uint16)
            for half in () if looked else halves:
                unlike = np.bitwise_count(half.take(x, axis=0) ^ half.take(y, axis=0))
                for column in unlike.T:
                    spent += column
                near = spent <= WIDE_BUDGET
                x, y, spent = x[near], y[near], spent[near]
            found = len(links)
            for a, b in zip(x.tolist(), y.tolist(), strict=True):
                p, q = root(a), root(b)
                if p != q:
                    label[max(p, q)] = min(p, q)
                    links.append((a, b))
            while found < len(links) and (label != (up := label[label])).any():
                label[:] = up

    def walk(members: np.ndarray) -> None:
        """Joins the tries of one subtrie's members; those that are joined already, if most are, are one trie."""
        while True:
            _, at, count = np.unique(label[members], return_inverse=True, return_counts=True)
            if len(count) < 2:
                return
            mine = at == count.argmax()
            first, rest = members[mine], members[~mine]
            if len(first) <= len(rest):
                pairs = wide_trie_links(sig[members])
            else:
                pairs, members = wide_trie_links(sig[first], sig[rest]), np.concatenate([first, rest])
            if pairs:
                join(*members[np.array(pairs)].T, looked=True)
            if len(first) <= len(rest):
                return
            members = rest

    begun, key, gap = None, np.empty(n, np.uint64), np.empty(n - 1, np.uint64)
    row = lambda places: (key[places] & own).astype(np.int64)
    for at, width, kept in names:
        if at != begun:
            begun, (k, off) = at, divmod(at, BITS)
            piece = sig[:, k] << np.uint64(off)
            if off + width > BITS:
                piece |= sig[:, k + 1] >> np.uint64(BITS - off)
            piece >>= np.uint64(BITS - width)
        # Members of one subtrie lie together: a mix of their name, then the row. Names that mix alike are one subtrie.
        np.bitwise_and(piece, np.uint64(kept), out=key)
        np.multiply(key, np.uint64(0x9E3779B97F4A7C15), out=key)
        np.bitwise_and(key, ~own, out=key)
        np.bitwise_or(key, rows, out=key)
        key.sort()
        same = np.flatnonzero(np.bitwise_xor(key[1:], key[:-1], out=gap) <= own)
        if not len(same):
            continue
        # Members of subtries but for the first ones: their place, their subtrie, and its first and last place.
        begins = np.flatnonzero(np.diff(same, prepend=-2) != 1)
        trie = np.repeat(np.arange(len(begins)), np.diff(begins, append=len(same)))
        first, last = same[begins], same[np.append(begins[1:], len(same)) - 1] + 1
        apart = np.zeros(len(begins), bool)
        apart[trie[label[row(same + 1)] != label[row(first[trie])]]] = True
        few = last - first < FEW
        todo = (apart & few)[trie]
        place, end = same[todo], last[trie[todo]]
        step = 1
        while len(place):
            join(row(place), row(place + step))
            step += 1
            more = place + step <= end
            place, end = place[more], end[more]
        for k in np.flatnonzero(apart & ~few).tolist():
            members = row(np.arange(first[k], last[k] + 1))
            join(np.full(len(members) - 1, members[0]), members[1:])
            walk(members)
    return links


def signatures(docs: DataFrame, text_col: str, names: list[str]) -> DataFrame:
    """``docs`` with the signature in the columns ``names``."""

    @F.pandas_udf("array<long>")
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([np.array(signature_of(t), np.uint64).view(np.int64) for t in texts])

    made = fresh_name(docs, "signature")
    signed = docs.withColumn(made, sign(text_of(docs, text_col)))
    return signed.withColumns({n: F.col(made)[k] for k, n in enumerate(names)}).drop(made)


def exact_links(distinct: DataFrame, count: int, most_members: int) -> DataFrame:
    """Links (a, b) of the distinct signatures (columns node and s0 to s7), spanning all that differ within the budget.

    A task joins about ``most_members`` with themselves, or fewer. Where one doesn't hold all, signatures are dealt to the
    points of a plane over a prime number, and each task has a line: two points lie on one line, so that any two
    signatures meet. Where there are few lines, each of several tasks takes some of the names.
    """
    words = [f"s{k}" for k in range(WIDE // BITS)]
    order = max(1, math.ceil(count / most_members))
    while any(order % k == 0 for k in range(2, math.isqrt(order) + 1)):
        order += 1
    members = math.ceil(count / order)
    names = names_for(members) if members > MOST_WALKED else []
    slices = max(1, SLICES // (order * (order + 1))) if names else 1
    # The line of slope m through (x, y) is named by m and where it meets x = 0; the upright one by x.
    lines = f"sequence(0, {order})" if order > 1 else "array(0)"
    keyed = distinct.select("node", *words, F.expr(f"pmod(xxhash64(node), {order}L)").alias("x"), F.expr(f"pmod(xxhash64(node, 1), {order}L)").alias("y"), F.explode(F.expr(lines)).alias("slope"))
    keyed = keyed.withColumn("meets", F.expr(f"if(slope = {order}, x, pmod(y - slope * x, {order}L))"))
    keyed = keyed.select(F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "slope", "meets", "node", *words)

    def join(key: tuple, members: pa.Table) -> pa.Table:
        node = members["node"].to_numpy()
        sig = np.column_stack([members[w].to_numpy() for w in words]).view(np.uint64)
        links = named_links(sig, names[key[0].as_py() :: slices]) if names else wide_trie_links(sig)
        pairs = np.array(links, np.int64).reshape(-1, 2)
        return pa.table({"a": node[pairs[:, 0]], "b": node[pairs[:, 1]]})

    found = keyed.groupBy("slice", "slope", "meets").applyInArrow(join, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def similar_links(distinct: DataFrame, count: int, most_members: int = MOST_MEMBERS, recall: float = RECALL) -> DataFrame:
    """:func:`exact_links` if ``recall`` is 1 (or tables are more work); below, the links whose signatures share a table's subtrie."""
    tables = tables_for(count, recall)
    if tables == [[]]:
        return exact_links(distinct, count, most_members)
    words = [f"s{k}" for k in range(WIDE // BITS)]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.column_stack([batch.column(1 + k).to_numpy() for k in range(len(words))])
            bits = np.unpackbits(sig.astype(">i8").view(np.uint8).reshape(len(sig), -1), axis=1)
            for t, places in enumerate(tables):
                key = bits[:, places].astype(np.int64) @ (1 << np.arange(len(places), dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sig), t, np.int32)), pa.array(key), *batch.columns], names=["t", "key", "node", *words])

    keyed = distinct.select("node", *words).mapInArrow(spread, ", ".join(["t int", "key long", "node long", *(f"{w} long" for w in words)]))
    keyed = keyed.withColumns({"pair": F.lit(0).cast("long"), "side": F.lit(0)})
    large = keyed.groupBy("t", "key").count().where(F.col("count") > most_members)
    large = written(large.select("t", "key", F.ceil(F.col("count") / most_members).cast("int").alias("parts")), "large")
    if not large.isEmpty():
        split = keyed.drop("pair", "side").join(large, ["t", "key"])
        split = split.withColumn("own", F.expr("cast(pmod(xxhash64(node), parts) as int)")).withColumn("with", F.explode(F.expr("sequence(0, parts - 1)")))
        pair = F.least("own", "with").cast("long") * (1 << 31) + F.greatest("own", "with")
        split = split.select("t", "key", "node", *words, pair.alias("pair"), (F.col("own") > F.col("with")).cast("int").alias("side"))
        # A part joined with itself is one join, of one side.
        keyed = keyed.join(large, ["t", "key"], "left_anti").unionByName(split)

    def join(members: pa.Table) -> pa.Table:
        node, side = members["node"].to_numpy(), members["side"].to_numpy()
        sig = np.column_stack([members[w].to_numpy() for w in words]).view(np.uint64)
        order = np.argsort(side, kind="stable")
        cut = int(np.count_nonzero(side == 0))
        sig, node = sig[order], node[order]
        pairs = np.array(wide_trie_links(sig[:cut], sig[cut:] if cut < len(sig) else None), np.int64).reshape(-1, 2)
        return pa.table({"a": node[pairs[:, 0]], "b": node[pairs[:, 1]]})

    return keyed.groupBy("t", "key", "pair").applyInArrow(join, "a long, b long")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: one with the least id.

    Groups are the components of all pairs of texts whose five-word shingles are alike to 0.8, by their signatures.
    Rows with a null id stay. Rows are told apart one by one: an id that repeats with another text stays
    where that text's group has no other row; of rows that repeat, one stays.
    """
    words = [f"s{k}" for k in range(WIDE // BITS)]
    taken = docs
    names: list[str] = []
    for stem in ("row", *words):
        names.append(fresh_name(taken, stem))
        taken = taken.withColumn(names[-1], F.lit(None))
    marked = written(signatures(docs.withColumn(names[0], F.monotonically_increasing_id()), text_col, names[1:]), "signed")
    rows = marked.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), *[F.col(n).alias(c) for n, c in zip(names, ("row", *words), strict=True)])
    distinct = rows.groupBy(*words).agg(F.min(F.struct("id", "row")).alias("least"))
    distinct = written(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct")
    found = components(exact_links(distinct, distinct.count(), MOST_NAMED))
    roots = distinct.join(found, "node", "left").select(*words, "least", F.coalesce("root", "node").alias("root"))
    roots = written(roots, "rooted")
    named = by_root(roots, F.min("least")).select(*words, F.col("named.row").alias("chosen"))
    gone = rows.join(named, words).where("row <> chosen").select(F.col("row").alias("gone"))
    return marked.join(gone, marked[names[0]] == gone["gone"], "left_anti").select(*docs.columns)
