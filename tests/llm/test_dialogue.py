"""Repair of conversations against a plain search over whole strings."""

from __future__ import annotations

import hashlib
import os
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from crosspan.llm import dialogue, queries

SF = "/root/testdata/sf0.001"
KIND = "conv_id long, turn long, role string, text string"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def first_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        trimmed = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not trimmed.lstrip(" \t\n\x0b\x0c\r") else "duplicate" if (role, text) in seen else "truncated" if trimmed[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired lines): every state holds its least (cost, audit) as whole strings."""
    best = {"": (0, "", [])}

    def offer(to, key, value):
        if key not in to or value[:2] < to[key][:2]:
            to[key] = value

    def inserted(cells):
        out = dict(cells)
        for _ in range(4):
            for state, (cost, audit, lines) in list(out.items()):
                for role in ("user", "assistant"):
                    if (state, role[0]) in NEXT:
                        offer(out, role[0], (cost + 2, audit + "I", [*lines, f"{role}:"]))
        return out

    for (_, role, text), fault in zip(rows, first_faults(rows), strict=True):
        cells: dict = {}
        for state, (cost, audit, lines) in inserted(best).items():
            offer(cells, state, (cost + 3, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            extra = fault == "truncated"
            if (state, role[:1]) in NEXT:
                offer(cells, role[0], (cost + extra, audit + "K", [*lines, f"{role}:{text}"]))
            for other in ("user", "assistant"):
                if (state, other[0]) in NEXT:
                    offer(cells, other[0], (cost + 2 + extra, audit + "R", [*lines, f"{other}:{text}"]))
        best = cells
    ends = inserted(best)
    return min((ends[s] for s in ("", "a") if s in ends), key=lambda v: v[:2])


def summary(rows):
    """What the query gives for rows (turn, role, text) in order."""
    faults, turns = first_faults(rows), [t for t, _, _ in rows if t is not None]
    cost, audit, lines = cheapest(rows)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def hurt(table):
    out = []
    for c, turn, role, text in table:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        if k:
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            out += [(c, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def key(row):
    _, turn, role, text = row
    return turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).digest()


def brute(table):
    groups: dict = {c: [] for c, *_ in table}
    for row in hurt(table):
        groups[row[0]].append(row)
    return sorted(((c, *summary([r[1:] for r in sorted(rows, key=key)])) for c, rows in groups.items()), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("sf", [SF, SF.replace("0.001", "0.01")])
def test_registered_query_against_brute_force(spark, sf):
    table = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op12_dialogue(spark, sf)) == brute(table)


def invented(rnd, conversations, longest):
    texts = ["One.", "Two", "", " \n", "Why?", "one more!", "x" * 50, "ß漢.", None, "Three. \t"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", "sys", None, "User"]
    return [(c if c % 7 else None if c == 7 else c, rnd.choice([None, k, k, k, k // 2, k * 3]), rnd.choice(roles), f"{rnd.choice(texts)}" if rnd.random() < 0.7 else f"{rnd.random()}.") for c in range(conversations) for k in range(rnd.randrange(longest))]


def test_random_conversations(spark):
    rows = invented(random.Random(3), 150, 14)
    rows += [(900, k, "user", f"turn {k}.") for k in range(60)] + [(901, k, "system", f"turn {k}") for k in range(25)] + [(902, None, None, None)] * 4 + [(903, k, "assistant", "same.") for k in range(9)]
    rows += [(None, 5, "user", "no id."), (None, 6, "assistant", "none.")]
    df = spark.createDataFrame(rows, KIND)
    assert got(dialogue.repair_digests(df.repartition(5).withColumns({c: F.lit(1) for c in ("side", "copy", "audit", "digest", "fault", "c", "part")}))) == brute(rows)


def test_a_conversation_in_many_chunks_and_tasks(spark, monkeypatch):
    monkeypatch.setattr(dialogue.chunks, "__defaults__", (3,))
    monkeypatch.setattr(dialogue.audits, "__defaults__", (3,))
    rnd = random.Random(8)
    rows = [(1, k, rnd.choice(["user", "user", "assistant", "system"]), rnd.choice([f"{k}.", f"{k}", "again."])) for k in range(400)] + invented(rnd, 20, 9)
    rows += [(77, k, "user", f"{k}!") for k in range(300)]
    spark.conf.set("spark.sql.shuffle.partitions", 11)
    try:
        assert got(dialogue.repair_digests(spark.createDataFrame(rows, KIND))) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


@pytest.mark.parametrize("modulus", [1, 7, (1 << 61) - 1])
def test_prefixes_compare_like_strings_whatever_their_hashes(monkeypatch, modulus):
    monkeypatch.setattr(dialogue.Trails, "MODULUS", modulus)
    rnd, trails = random.Random(5), dialogue.Trails()
    nodes = [0]
    for _ in range(700):
        nodes.append(trails.push(rnd.choice(nodes[-40:]), rnd.choice("DIKR" if rnd.random() < 0.2 else "K")))
    strings = {n: trails.text(n) for n in nodes}
    for _ in range(4000):
        a, b = rnd.choice(nodes), rnd.choice(nodes)
        assert trails.less(a, b) == (strings[a] < strings[b])
        c, d = trails.common(a, b)
        assert strings[c] == strings[d] == os.path.commonprefix([strings[a], strings[b]])
        assert strings[trails.ancestor(a, trails.depth[a] // 2)] == strings[a][: trails.depth[a] // 2]


@pytest.mark.parametrize("modulus", [2, (1 << 61) - 1])
def test_tables_of_edits_against_whole_strings(monkeypatch, modulus):
    monkeypatch.setattr(dialogue.Trails, "MODULUS", modulus)
    rnd, kinds = random.Random(2), {"": 0, "blank": 1, "duplicate": 2, "truncated": 3}
    for _ in range(150):
        rows = [(k, rnd.choice(["user", "assistant", "system", "tool"]), rnd.choice([f"{k}.", f"{k}", "same.", ""])) for k in range(rnd.randrange(12))]
        cut = rnd.randrange(len(rows) + 1)
        own = dialogue.Joined()
        known = [(t, r[:1], kinds[f]) for (t, r, _), f in zip(rows, first_faults(rows), strict=True)]
        for part in (known[:cut], known[cut:]):
            if part:
                own.add(dialogue.chunk(1, part, part is known))
        result = own.result()
        assert (result["cost"], result["audit"]) == cheapest(rows)[:2]
        assert result["illegal"] == summary(rows)[4]


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hello."), (1, 2, "assistant", "cut"), (2, 0, None, None), (3, 0, "assistant", "Yes."), (3, 0, "assistant", "Yes."), (4, None, "system", "Be."), (4, 3, "user", "So?")]
    out = dialogue.repair(spark.createDataFrame(rows, KIND).withColumn("place", F.lit("clash")))
    assert sorted(tuple(r) for r in out.collect()) == [
        (1, 0, "K", "user", "Hi."), (1, 1, "I", "assistant", ""), (1, 2, "K", "user", "Hello."), (1, 3, "K", "assistant", "cut"), (3, 0, "I", "user", ""), (3, 1, "K", "assistant", "Yes."),
        (4, 0, "K", "system", "Be."), (4, 1, "K", "user", "So?"), (4, 2, "I", "assistant", ""),
    ]


def test_empty_table_and_ids_of_other_kinds(spark):
    empty = spark.createDataFrame([], KIND)
    assert dialogue.repair(empty).collect() == [] and dialogue.repair_digests(empty).collect() == []
    big = (1 << 60) + 1
    rows = [(big, 0, "user", "Long ids stay."), (big, 1, "assistant", "Whole.")]
    assert {r.conv_id for r in dialogue.repair(spark.createDataFrame(rows, KIND)).collect()} == {big}
    text = spark.createDataFrame([("a", 0, "user", "w " * 200_000 + "."), ("a", 1, "assistant", "Fine.")], "conv_id string, turn long, role string, text string")
    assert [(r.conv_id, len(r.text)) for r in dialogue.repair(text).orderBy("place").collect()] == [("a", 400_001), ("a", 5)]
