"""Repair of conversations: the cheapest edits that make their roles legal, and an audit of them.

A conversation's rows, in order, are kept (0), given another role (2) or deleted (3), and empty rows
may be inserted (2 each), so that the roles' initials read ``(s?(ua)+)?``. Blank rows and repetitions
must go; a truncated row that stays adds 1. Of equally cheap edits the audit, their initials in order,
is the least in ASCII.

The dynamic programme over rows keeps one prefix of edits for each of four states. Prefixes are
persistent: a node is one edit linked to the node before, with its 2^k-th ancestors and a rolling hash
(:class:`Trails`), so states share what they have in common and a tie is decided by a binary search for
the longest common prefix; equal hashes are confirmed by the edits themselves. No prefix of one state
begins another of equal cost, since the edits determine the state: so prefixes can be compared at once.

Rows are dealt by ranges of (conversation, turn, role, digest), hence one conversation may lie in many
tasks. A task cuts it into chunks and works out the best edits from each state to each (a product of
small tables of costs and prefixes, which is associative); the chunks of a conversation are then
joined in order. Texts aren't read for that, only their digests and faults. They are read once more
for the repaired rows, streamed past the audit in order, a row at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosspan.llm.common import written

DROPPED, EMPTIED, UNSTOPPED, REPEATED, MADE_USER, SIDES = 0, 1, 2, 3, 4, 20  #: remainders of crc32 by 20
CHUNK = 2048  #: rows of a conversation that one table of prefixes covers
SPACE = " \t\n\x0b\x0c\r"
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
START, SYSTEM, USER, ASSISTANT = range(4)  #: what the prefix ends with; START and ASSISTANT may end it
KEEP_COST, REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 2, 3, 2, 1
#: (from, to) of an inserted row, in an order in which one pass reaches all that insertions reach.
INSERTED = ((START, USER), (SYSTEM, USER), (ASSISTANT, USER), (USER, ASSISTANT))
NAMES = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
SOURCE = ("conv_id", "turn", "role", "text")


def follows(state: int, initial: str) -> int | None:
    """The state after a row with this role's initial, or None if it may not stand there."""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return USER if state != USER else None
    return ASSISTANT if initial == "a" and state == USER else None


# ------------------------------------------------------------------- rows and faults, in DataFrames


def damaged(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with planted faults by crc32 of ``conv_id:turn`` modulo 20: for tests of repair. Nulls become one space."""
    plain = lambda c: F.coalesce(turns[c].cast("string"), F.lit(" "))
    side = F.pmod(F.crc32(F.concat_ws(":", plain(conv), plain(turn)).cast("binary")), F.lit(SIDES))
    rows = turns.select(turns[conv].alias("conv_id"), turns[turn].alias("turn"), plain(role).alias("role"), plain(text).alias("text"), side.alias("side")).where(F.col("side") != DROPPED)
    rows = rows.withColumns({
        "role": F.when(F.col("side") == MADE_USER, "user").otherwise(F.col("role")),
        "text": F.when(F.col("side") == EMPTIED, "").when(F.col("side") == UNSTOPPED, F.translate("text", ".!?", "")).otherwise(F.col("text")),
    })
    return rows.withColumn("copy", F.explode(F.when(F.col("side") == REPEATED, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select(*SOURCE)


def digest() -> Column:
    """Of role and text; the role's length keeps them apart."""
    return F.unhex(F.sha2(F.concat_ws(":", F.length("role"), "role", "text").cast("binary"), 256))


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, copy, fault) of every row: narrow, whatever its text's length.

    Equal rows of a turn are counted before they are dealt, and numbered after. A row's role and text
    have been seen if a row with its digest has a lower turn or, in its turn, a lower number.
    """
    trimmed = F.rtrim("text", F.lit(SPACE))
    own = F.when(trimmed == "", BLANK).when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(0)
    counted = rows.select("conv_id", "turn", "role", digest().alias("digest"), own.alias("own")).groupBy("conv_id", "turn", "role", "digest", "own").count()
    order = F.struct(F.col("turn").isNotNull(), "turn")
    firsts = counted.groupBy(F.col("conv_id").alias("c"), F.col("digest").alias("d")).agg(F.min(order).alias("first"))
    each = counted.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d"))).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("count"))))
    seen = (order != F.col("first")) | (F.col("copy") > 1)
    return each.select("conv_id", "turn", "role", "digest", "copy", F.when((F.col("own") != BLANK) & seen, DUPLICATE).otherwise(F.col("own")).alias("fault"))


# ------------------------------------------------------------------------------ persistent prefixes


class Trails:
    """Strings as linked nodes that share their beginnings; node 0 is the empty one."""

    MODULUS, BASE = (1 << 61) - 1, 1_000_003

    def __init__(self) -> None:
        self.char, self.depth, self.hash, self.up = [""], [0], [0], [()]
        self.confirmed: set[tuple[int, int]] = set()

    def push(self, node: int, char: str) -> int:
        ups, k = [node], 0
        while k < len(self.up[ups[k]]):  # the 2^(k+1)-th ancestor is the 2^k-th one's
            ups.append(self.up[ups[k]][k])
            k += 1
        self.up.append(tuple(ups))
        self.char.append(char)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * self.BASE + ord(char)) % self.MODULUS)
        return len(self.char) - 1

    def ancestor(self, node: int, depth: int) -> int:
        """The node's prefix of this length."""
        over = self.depth[node] - depth
        while over:
            k = over.bit_length() - 1
            node, over = self.up[node][k], over - (1 << k)
        return node

    def equal(self, a: int, b: int) -> bool:
        """Whether two nodes of one depth are one string, by the edits back to a shared or confirmed node."""
        walked = []
        while a != b and (a, b) not in self.confirmed:
            if self.char[a] != self.char[b]:
                return False
            walked.append((a, b))
            a, b = self.up[a][0], self.up[b][0]
        self.confirmed.update(walked)
        return True

    def common(self, a: int, b: int) -> tuple[int, int]:
        """The longest prefixes of two nodes that are equal."""
        least = min(self.depth[a], self.depth[b])
        a, b = self.ancestor(a, least), self.ancestor(b, least)
        c, d = a, b
        if self.hash[c] != self.hash[d]:
            for k in range(self.depth[c].bit_length() - 1, -1, -1):
                if k < len(self.up[c]) and self.hash[self.up[c][k]] != self.hash[self.up[d][k]]:
                    c, d = self.up[c][k], self.up[d][k]
            c, d = self.up[c][0], self.up[d][0]
        if self.equal(c, d):
            return c, d
        while not self.equal(a, b):  # unequal strings with one hash: by the edits alone
            a, b = self.up[a][0], self.up[b][0]
        return a, b

    def less(self, a: int, b: int) -> bool:
        """Whether a's string comes before b's."""
        if a == b:
            return False
        c, d = self.common(a, b)
        depth = self.depth[c]
        if self.depth[a] == depth or self.depth[b] == depth:
            return self.depth[a] < self.depth[b]
        return self.char[self.ancestor(a, depth + 1)] < self.char[self.ancestor(b, depth + 1)]

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.char[node])
            node = self.up[node][0]
        return "".join(reversed(out))


Prefixes = list[tuple[int, int] | None]  #: by state: cost, node


def better(trails: Trails, new: tuple[int, int], old: tuple[int, int] | None) -> bool:
    return old is None or new[0] < old[0] or new[0] == old[0] and trails.less(new[1], old[1])


def with_insertions(trails: Trails, prefixes: Prefixes) -> Prefixes:
    out = list(prefixes)
    for a, b in INSERTED:
        if out[a] is not None and (out[b] is None or out[a][0] + INSERT_COST <= out[b][0]):
            new = (out[a][0] + INSERT_COST, trails.push(out[a][1], "I"))
            if better(trails, new, out[b]):
                out[b] = new
    return out


def after_row(trails: Trails, prefixes: Prefixes, initial: str, fault: int) -> Prefixes:
    out: Prefixes = [None] * 4
    stays = TRUNCATED_COST if fault == TRUNCATED else 0
    for state, prefix in enumerate(with_insertions(trails, prefixes)):
        if prefix is None:
            continue
        edits = [(state, "D", DELETE_COST)]
        if fault not in (BLANK, DUPLICATE):
            edits.append((ASSISTANT if state == USER else USER, "R", REROLE_COST + stays))
            if (kept := follows(state, initial)) is not None:
                edits.append((kept, "K", KEEP_COST + stays))
        for to, edit, cost in edits:
            total = prefix[0] + cost
            if out[to] is None or total <= out[to][0]:
                new = (total, trails.push(prefix[1], edit))
                if better(trails, new, out[to]):
                    out[to] = new
    return out


def table(rows: list[tuple[str, int]], starts: range) -> tuple[list[int | None], list[str | None]]:
    """Costs and edits of the best prefixes over ``rows`` (initial, fault) from each start to each state."""
    costs: list[int | None] = []
    edits: list[str | None] = []
    for start in range(4):
        trails, prefixes = Trails(), [None] * 4
        if start in starts:
            prefixes[start] = (0, 0)
            for initial, fault in rows:
                prefixes = after_row(trails, prefixes, initial, fault)
        costs += [p and p[0] for p in prefixes]
        edits += [trails.text(p[1]) if p else None for p in prefixes]
    return costs, edits


# ------------------------------------------------------------------- chunks, and what they add up to

CHUNKS = "part int, place long, n long, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, head string, tail string, costs array<long>, edits array<string>"
COUNTS = ("blank", "duplicate", "truncated", "illegal")


def legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def batches_of(records: Iterator[dict], schema: pa.Schema, size: int = 256) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for r in records:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def arrow_schema(df: DataFrame, columns: str) -> pa.Schema:
    """``conv_id`` as in ``df``, and ``columns``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    return to_arrow_schema(StructType([df.schema["conv_id"], *_parse_datatype_string(columns)]))


def chunk(conv, rows: list[tuple], whole: bool) -> dict:
    """One record for rows (turn, initial, fault) in order. ``whole``: nothing of the conversation precedes them."""
    turns = [t for t, _, _ in rows if t is not None]
    costs, edits = table([(i, f) for _, i, f in rows], range(1 if whole else 4))
    out = {"conv_id": conv, "n": len(rows), "turns": len(set(turns)), "low": min(turns, default=None), "high": max(turns, default=None), "head": rows[0][1], "tail": rows[-1][1], "costs": costs, "edits": edits}
    out |= {name: sum(f == k for _, _, f in rows) for name, k in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED))}
    return out | {"illegal": sum(not legal(a[1], b[1]) for a, b in zip(rows, rows[1:], strict=False))}


def chunks(found: DataFrame, parts: int, size: int = CHUNK) -> DataFrame:
    """Records of stretches of conversations, from rows of :func:`faults`."""
    order = ("conv_id", "turn", "role", "digest", "copy")
    narrow = found.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "fault")
    schema = arrow_schema(found, CHUNKS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def records() -> Iterator[dict]:
            conv, held, place, whole = None, [], 0, False

            def closed() -> dict:
                return chunk(conv, held, whole) | {"part": part, "place": place}

            for b in batches:
                for c, *row in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                    if held and (c != conv or len(held) >= size):
                        yield closed()
                        whole, held, place = c != conv, [], place + 1
                    conv = c
                    held.append(tuple(row))
            if held:
                yield closed()

        yield from batches_of(records(), schema)

    return narrow.mapInArrow(cut, f"conv_id {found.schema['conv_id'].dataType.simpleString()}, {CHUNKS}")


class Joined:
    """The chunks of one conversation, one after another. Prefixes are chains of pieces, shared like nodes."""

    def __init__(self) -> None:
        self.prefixes: list[tuple[int, tuple] | None] = [(0, ()), None, None, None]  # a piece: (the chain before, its text)
        self.counts = dict.fromkeys((*COUNTS, "turns"), 0)
        self.low = self.high = self.tail = None

    @staticmethod
    def less(a: tuple, b: tuple) -> bool:
        """By the pieces behind the last chain that both share. Both cover the same chunks, so they have as many."""
        x, y = [], []
        while a is not b:
            x.append(a[1])
            y.append(b[1])
            a, b = a[0], b[0]
        return "".join(reversed(x)) < "".join(reversed(y))

    def add(self, r: dict) -> None:
        ends: list[tuple[int, tuple] | None] = [None] * 4
        for start, prefix in enumerate(self.prefixes):
            for end in range(4):
                if prefix is None or (cost := r["costs"][4 * start + end]) is None:
                    continue
                new = (prefix[0] + cost, (prefix[1], r["edits"][4 * start + end]))
                if ends[end] is None or new[0] < ends[end][0] or new[0] == ends[end][0] and self.less(new[1], ends[end][1]):
                    ends[end] = new
        self.prefixes = ends
        for k in COUNTS:
            self.counts[k] += r[k]
        self.counts["illegal"] += self.tail is not None and not legal(self.tail, r["head"])
        self.counts["turns"] += r["turns"] - (self.high is not None and r["low"] == self.high)
        self.low, self.high, self.tail = (r["low"] if self.low is None else self.low), (self.high if r["high"] is None else r["high"]), r["tail"]

    def result(self) -> dict:
        """The cheapest legal end, with insertions behind the last row."""
        ends = []
        for state, prefix in enumerate(self.prefixes):
            added = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}[state]
            if prefix is not None:
                ends.append((prefix[0] + INSERT_COST * len(added), "".join(self.pieces(prefix[1])) + added))
        cost, audit = min(ends)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.counts["turns"]
        return {"gaps": gaps, **{k: self.counts[k] for k in COUNTS}, "cost": cost, "audit": audit}

    @staticmethod
    def pieces(chain: tuple) -> list[str]:
        out = []
        while chain:
            out.append(chain[1])
            chain = chain[0]
        return out[::-1]


AUDITS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def audits(rows: DataFrame, everyone: DataFrame, size: int = CHUNK) -> DataFrame:
    """One row for each conversation of ``everyone``: gaps, faults, illegal neighbours, cost and audit of ``rows``."""
    found = faults(rows)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nobody = everyone.select("conv_id").distinct().select("conv_id", *(F.lit(-1 if c.startswith("part ") else None).cast(c.split(" ", 1)[1]).alias(c.split(" ", 1)[0]) for c in CHUNKS.split(", ")))
    every = written(chunks(found, parts, size), "chunks").unionByName(nobody)
    schema = arrow_schema(found, AUDITS)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[dict]:
            conv, own = None, None
            for b in batches:
                for r in b.to_pylist():
                    if own is None or r["conv_id"] != conv:
                        if own is not None:
                            yield {"conv_id": conv} | own.result()
                        conv, own = r["conv_id"], Joined()
                    if r["part"] >= 0:
                        own.add(r)
            if own is not None:
                yield {"conv_id": conv} | own.result()

        yield from batches_of(records(), schema)

    ordered = every.repartition("conv_id").sortWithinPartitions("conv_id", "part", "place")
    return ordered.mapInArrow(join, f"conv_id {found.schema['conv_id'].dataType.simpleString()}, {AUDITS}")


# ---------------------------------------------------------------------------------- repaired rows


def streamed(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """Each conversation's audit, then its rows in order, whole in one partition, to be read row by row."""
    none = lambda t: F.lit(None).cast(t)
    kinds = dict(rows.dtypes)
    heads = judged.select("conv_id", F.lit(0).alias("side"), none(kinds["turn"]).alias("turn"), none("string").alias("role"), none("binary").alias("digest"), "audit", none("string").alias("text"))
    texts = rows.select("conv_id", F.lit(1).alias("side"), "turn", "role", digest().alias("digest"), none("string").alias("audit"), "text")
    return heads.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "side", "turn", "role", "digest").select("conv_id", "side", "audit", "role", "text")


def repaired_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conversation, edit, role, text) of every repaired row, and (conversation, None, None, None) before the first."""
    conv, audit, at, last, state = None, "", 0, 0, START

    def inserted() -> Iterator[tuple]:
        nonlocal at, state
        while audit[at : at + 1] == "I":
            state = ASSISTANT if state == USER else USER
            at += 1
            yield conv, "I", NAMES[state], ""

    for b in batches:
        for c, side, edits, role, text in zip(*(b.column(k) for k in range(5)), strict=True):
            if side.as_py() == 0:
                conv, audit, at, state = c.as_py(), edits.as_py(), 0, START
                last = len(audit.rstrip("I"))
                yield conv, None, None, None
                continue
            yield from inserted()
            edit, at = audit[at], at + 1
            if edit != "D":
                role = role.as_py()
                state = follows(state, role[:1]) if edit == "K" else ASSISTANT if state == USER else USER
                yield conv, edit, role if edit == "K" else NAMES[state], text.as_py()
            if at == last:  # insertions behind the last row
                yield from inserted()


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired conversations: (conv_id, place, edit, role, text), places from 0, edits K, R or I.

    Nulls in role and text count as one space, so a null text is blank. Rows go by turn, null first,
    then by role and the SHA-256 of role and text; equal rows count each. A null conv_id is a conversation of its own.
    Roles other than those with initials s, u, a can only be changed or deleted. A conversation without
    a row that stays isn't returned; an empty table gives an empty one. Other columns are neither read nor returned.
    """
    rows = turns.select(turns[conv].alias("conv_id"), turns[turn].alias("turn"), *(F.coalesce(turns[c].cast("string"), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))))
    source = streamed(rows, audits(rows, rows))
    columns = "place long, edit string, role string, text string"
    schema = arrow_schema(rows, columns)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[dict]:
            place = 0
            for c, edit, role, text in repaired_turns(batches):
                if edit is None:
                    place = 0
                else:
                    yield {"conv_id": c, "place": place, "edit": edit, "role": role, "text": text}
                    place += 1

        yield from batches_of(records(), schema)

    return source.mapInArrow(work, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {columns}")


def repair_digests(turns: DataFrame) -> DataFrame:
    """Of every conversation of ``turns`` (conv_id, turn, role, text) after :func:`damaged`: what :func:`audits` gives, and ``repaired_sha256``.

    A conversation of which no row is left has zeros, an empty audit and the digest of nothing. Order
    and nulls as in :func:`repair`.
    """
    rows = damaged(turns)
    judged = written(audits(rows, turns.select(turns["conv_id"].alias("conv_id"))), "audits")
    schema = arrow_schema(rows, "repaired_sha256 string")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[dict]:
            conv, own, first = None, None, True
            for c, edit, role, text in repaired_turns(batches):
                if edit is None:
                    if own is not None:
                        yield {"conv_id": conv, "repaired_sha256": own.hexdigest()}
                    conv, own, first = c, hashlib.sha256(), True
                else:
                    own.update(("" if first else "\n").encode() + f"{role}:".encode() + text.encode())
                    first = False
            if own is not None:
                yield {"conv_id": conv, "repaired_sha256": own.hexdigest()}

        yield from batches_of(records(), schema)

    kind = rows.schema["conv_id"].dataType.simpleString()
    hashed = streamed(rows, judged).mapInArrow(work, f"conv_id {kind}, repaired_sha256 string").withColumnRenamed("conv_id", "c")
    return judged.join(hashed, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "gaps", *COUNTS, "cost", "audit", "repaired_sha256")
