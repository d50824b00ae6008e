"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover.

Every 200-byte string that starts at two places of the corpus is to go. Two suffixes that tie for
200 bytes are found as in blockwise suffix-array construction with a difference cover:

1. *Cover sample.* Positions whose residue modulo ``PERIOD`` = q*q + q + 1 lies in a perfect
   difference set (12 of 133) are sampled. For any two positions i and j there is a d < PERIOD such
   that i + d and j + d are both sampled, so two suffixes that tie for 200 bytes tie at a sampled
   place for the 200 - PERIOD + 1 = 68 bytes after it. Suffixes whose samples all stand alone can't
   tie and are left out.
2. *Suffixes.* The rest are compared by short names of their 200 bytes; those whose name stands alone
   can't tie either. Names decide nothing else: equal names only say that bytes must be compared.
3. *Buckets.* What is left is dealt to buckets with its bytes. A suffix's *anchor* is the least
   8-byte string (by a fixed mix) in its 200 bytes, so equal suffixes have the same anchor at the same
   distance. Suffixes of one place whose distances to one anchor differ by less than ``GROUP`` go
   together as one row, and share the 137 bytes that lie in each of them: their *core*. A bucket is
   sorted by bytes: cores are ranked first, and that rank resolves what ties that long; the bytes
   before and behind it, sorted in turn, part the rest. Only equal bytes tie.

Whole copies of a text are named once by a digest of 128 bits; one of them stands for all in steps 2
and 3. A bucket's rows are counted by their bytes within a block first, so a passage that stands in a
third of all documents is one row a block.

Defined results: null texts are empty; texts under 200 bytes lose nothing; the rows that repeat a
document are copies of it, so each loses all bytes that lie in a 200-byte string; ids aren't used and
may be null or repeat; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from crosspan.llm.blocks import answers_of, block_table, bucket_count, documents_of, exchange, joined, rows_of, scaled

WIDTH, ORDER = 200, 11
PERIOD = ORDER * ORDER + ORDER + 1
#: Multipliers of the two rolling hashes (fixed odd numbers).
FIRST, SECOND = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
SEGMENT = 1 << 20
#: Suffixes in a row, the bytes that all of them share, and the bytes that a row can have.
GROUP, ANCHOR = 64, 8
CORE, SPAN = WIDTH - GROUP + 1, WIDTH + GROUP - 1


def difference_cover(q: int) -> list[int]:
    """A perfect difference set of q + 1 residues modulo q*q + q + 1, q prime (Singer).

    The powers g**k of a generator of GF(q**3) that lie in a plane through 0, by k.
    """
    modulus = q * q + q + 1

    def times_x(v: tuple[int, int, int], p: tuple[int, int, int]) -> tuple[int, int, int]:
        a, b, c = v  # a + b x + c x^2, with x^3 = p0 + p1 x + p2 x^2
        return (c * p[0] % q, (a + c * p[1]) % q, (b + c * p[2]) % q)

    for p in ((p0, p1, p2) for p0 in range(1, q) for p1 in range(q) for p2 in range(q)):
        v, found, seen = (1, 0, 0), [], 0
        for k in range(q**3 - 1):
            if v[2] == 0 and k < modulus:
                found.append(k)
            v = times_x(v, p)
            seen += 1
            if v == (1, 0, 0):
                break
        if seen == q**3 - 1 and len(found) == q + 1 and len({(a - b) % modulus for a in found for b in found}) == modulus:
            return found
    raise ValueError(f"no primitive polynomial for {q}")


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**k and base**-k modulo 2**64 for the positions of a segment."""
    if base not in _powers:
        n = SEGMENT + WIDTH
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(n, b, np.uint64)
            x[0] = 1
            out.append(np.cumprod(x, dtype=np.uint64))
        _powers[base] = (out[0], out[1])
    return _powers[base]


def names(data: np.ndarray, starts: np.ndarray, width: int, base: int) -> np.ndarray:
    """Fingerprints of the ``width`` bytes at the sorted ``starts``, equal for equal bytes."""
    up, down = powers(base)
    out = np.empty(len(starts), np.uint64)
    edges = np.searchsorted(starts, np.arange(0, len(data) + SEGMENT, SEGMENT))
    for k in range(len(edges) - 1):
        lo, hi = edges[k], edges[k + 1]
        if lo == hi:
            continue
        s = k * SEGMENT
        piece = data[s : s + SEGMENT + width].astype(np.uint64)
        piece += np.uint64(1)
        piece *= up[: len(piece)]
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(piece, out=sums[1:])
        at = starts[lo:hi] - s
        out[lo:hi] = (sums[at + width] - sums[at]) * down[at]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def samples(size: int, cover: np.ndarray) -> np.ndarray:
    """The sampled positions at which 68 bytes lie within a document of ``size`` bytes."""
    last = size - (WIDTH - PERIOD + 1)
    if last < 0 or size < WIDTH:
        return np.empty(0, np.int64)
    at = (np.arange(0, last + 1, PERIOD, dtype=np.int64)[:, None] + cover[None, :]).ravel()
    return at[at <= last]


class Numbered:
    """A block's distinct names in bucket order, and the way back to their places."""

    def __init__(self, first: np.ndarray, second: np.ndarray, buckets: int) -> None:
        self.keys, at, self.inverse, counts = np.unique(first, return_index=True, return_inverse=True, return_counts=True)
        self.twice = counts > 1
        dealt = scaled(second[at], buckets)
        self.order = np.argsort(dealt, kind="stable")
        self.edges = np.searchsorted(dealt[self.order], np.arange(buckets + 1))

    def payloads(self, flags: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(bucket, short keys then flag bits); ``flags`` say which keys are known to repeat."""
        keys, flags = self.keys[self.order].astype(np.uint32), flags[self.order]
        for b in np.flatnonzero(np.diff(self.edges)):
            lo, hi = self.edges[b], self.edges[b + 1]
            yield int(b), keys[lo:hi].tobytes() + np.packbits(flags[lo:hi]).tobytes()

    def repeated(self, answers: dict[int, bytes], shift: int = 0) -> np.ndarray:
        """Which of the block's places have a name that repeats."""
        out = np.zeros(len(self.keys), bool)
        for b in np.flatnonzero(np.diff(self.edges)):
            lo, hi = self.edges[b], self.edges[b + 1]
            bits = np.unpackbits(np.frombuffer(answers[int(b) + shift], np.uint8), count=int(hi - lo))
            out[self.order[lo:hi]] = bits.astype(bool)
        return out[self.inverse]


def ties(payloads: list[bytes]) -> list[bytes]:
    """Sort one bucket of short names; for each payload the bits of those that stand elsewhere too."""
    counts = [(8 * len(p)) // 33 for p in payloads]
    keys = np.concatenate([np.frombuffer(p, np.uint32, n) for p, n in zip(payloads, counts, strict=True)])
    flags = np.concatenate([np.unpackbits(np.frombuffer(p, np.uint8, offset=n * 4), count=n) for p, n in zip(payloads, counts, strict=True)])
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    same = sorted_keys[1:] == sorted_keys[:-1]
    tied = np.zeros(len(keys), bool)
    tied[order[1:]] |= same
    tied[order[:-1]] |= same
    tied |= flags.astype(bool)
    edges = np.concatenate([[0], np.cumsum(counts)])
    return [np.packbits(tied[a:b]).tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]


def anchors(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The distance from each of the sorted ``starts`` to its anchor: the first of the least 8-byte strings."""
    out = np.empty(len(starts), np.int64)
    wide = WIDTH - ANCHOR + 1
    edges = np.searchsorted(starts, np.arange(0, len(data) + SEGMENT, SEGMENT))
    for k in range(len(edges) - 1):
        lo, hi = edges[k], edges[k + 1]
        if lo == hi:
            continue
        s = int(starts[lo])
        word = data[s : int(starts[hi - 1]) + WIDTH].astype(np.uint64)
        for step in (1, 2, 4):
            word = (word[:-step] << np.uint64(8 * step)) | word[step:]
        word = (word ^ (word >> np.uint64(31))) * np.uint64(FIRST)
        # The upper bits order the strings, the lower ones, a place in the segment, prefer the first.
        word = (word & ~np.uint64(0x3FFFFF)) | np.arange(len(word), dtype=np.uint64)
        n = -(-len(word) // wide) * wide
        padded = np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF))
        padded[: len(word)] = word
        parts = padded.reshape(-1, wide)
        ahead = np.minimum.accumulate(parts, axis=1).ravel()
        behind = np.minimum.accumulate(parts[:, ::-1], axis=1)[:, ::-1].ravel()
        at = starts[lo:hi] - s
        least = np.minimum(behind[at], ahead[at + wide - 1])
        out[lo:hi] = (least & np.uint64(0x3FFFFF)).astype(np.int64) - at
    return out


def grouped(data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[bytes, bytes, int, np.ndarray]]:
    """Rows of the sorted ``starts``: (core, row, place, the starts); a row is 64 flags, then bytes.

    Flag w says that the string at ``place`` + w is meant; the bytes go from the first to the last end.
    """
    if not len(starts):
        return
    distance = anchors(data, starts)
    group = distance // GROUP
    place = starts + distance - GROUP * group - (GROUP - 1)
    cuts = np.flatnonzero((np.diff(place) != 0) | (np.diff(group) != 0)) + 1
    edges = [0, *cuts.tolist(), len(starts)]
    raw = data.tobytes()
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        mine, at = starts[lo:hi], int(place[lo])
        flags = np.bitwise_or.reduce(np.uint64(1) << (mine - at).astype(np.uint64))
        yield raw[at + GROUP - 1 : at + WIDTH], int(flags).to_bytes(8, "little") + raw[int(mine[0]) : int(mine[-1]) + WIDTH], at, mine


def packed_rows(rows: dict[bytes, bool]) -> bytes:
    """Rows and whether each is known to repeat, as one payload."""
    flags = np.frombuffer(b"".join(r[:8] for r in rows), "<u8")
    many = np.packbits(np.fromiter(rows.values(), bool, len(rows))).tobytes()
    return len(rows).to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(flags.tobytes() + many + b"".join(r[8:] for r in rows))


def low_and_high(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the first and the last set flag."""
    bits = np.unpackbits(flags.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.argmax(axis=1), GROUP - 1 - bits[:, ::-1].argmax(axis=1)


def sorted_ties(payloads: list[bytes]) -> list[bytes]:
    """Sort one bucket by bytes; for each payload's rows the flags of the strings that stand elsewhere too."""
    flags, many, lines = [], [], []
    counts = []
    for p in payloads:
        n = int.from_bytes(bytes(p[:4]), "little")
        raw = zstandard.ZstdDecompressor().decompress(bytes(p[4:]))
        f = np.frombuffer(raw, "<u8", n)
        bits = -(-n // 8)
        many.append(np.unpackbits(np.frombuffer(raw, np.uint8, bits, 8 * n), count=n).astype(bool))
        first, last = low_and_high(f)
        size = last - first + WIDTH
        text = np.frombuffer(raw, np.uint8, offset=8 * n + bits)
        line = np.zeros((n, SPAN), np.uint8)
        at = np.repeat(np.arange(n) * SPAN + first - (np.cumsum(size) - size), size) + np.arange(len(text))
        line.ravel()[at] = text
        flags.append(f)
        lines.append(line)
        counts.append(n)
    return [t.astype("<u8").tobytes() for t in np.split(tied_flags(np.concatenate(lines), np.concatenate(flags), np.concatenate(many)), np.cumsum(counts)[:-1])]


def ordered(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows of a byte matrix, and how many leading bytes each shares with the one before."""
    width = columns.shape[1]
    order = np.argsort(np.ascontiguousarray(columns).view(f"V{width}").ravel(), kind="stable")
    unlike = columns[order[1:]] != columns[order[:-1]]
    return order, np.concatenate([[-1], np.where(unlike.any(axis=1), unlike.argmax(axis=1), width)])


def tied_flags(lines: np.ndarray, flags: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Of each row's flagged strings, those that stand in another row, or in one that is known to repeat."""
    out = np.where(many, flags, np.uint64(0))
    # Rows that agree in all bytes and flags tie at once.
    order, shared = ordered(np.hstack([flags.astype("<u8").view(np.uint8).reshape(-1, 8), lines]))
    equal = np.zeros(len(flags), bool)
    equal[order[1:]] |= shared[1:] == 8 + SPAN
    equal[order[:-1]] |= shared[1:] == 8 + SPAN
    name = np.empty(len(flags), np.int64)
    name[order] = np.cumsum(shared < 8 + SPAN) - 1
    out[equal] = flags[equal]
    # One of each is enough for the rest; those that tie wholly stand for two.
    kept = np.unique(name, return_index=True)[1]
    lines, flags, twice = lines[kept], flags[kept], out[kept] == flags[kept]
    # Ranks of the cores; only those with several rows, one of them open, are looked into.
    order, shared = ordered(lines[:, GROUP - 1 : WIDTH])
    core = np.empty(len(kept), np.int64)
    core[order] = np.cumsum(shared < CORE) - 1
    sizes, still = np.bincount(core), np.bincount(core, weights=~twice)
    open_rows = np.flatnonzero((sizes[core] > 1) & (still[core] > 0))
    found = np.where(twice, flags, np.uint64(0))
    if len(open_rows):
        lines, mine, twice, core = lines[open_rows], flags[open_rows], twice[open_rows], core[open_rows]
        ranked = core.astype(">u8").view(np.uint8).reshape(-1, 8)
        left, left_shared = ordered(np.hstack([ranked, lines[:, GROUP - 2 :: -1]]))
        right, right_shared = ordered(np.hstack([ranked, lines[:, WIDTH:]]))
        weight = 1 + twice.astype(np.int64)
        add = np.zeros(len(mine), np.uint64)
        a, b = np.empty(len(mine), np.int64), np.empty(len(mine), np.int64)
        for w in range(GROUP):
            rows = np.flatnonzero(mine >> np.uint64(w) & np.uint64(1))
            if not len(rows):
                continue
            a[left] = np.cumsum(left_shared < 8 + GROUP - 1 - w)
            b[right] = np.cumsum(right_shared < 8 + w)
            _, inverse = np.unique(a[rows] * (len(mine) + 1) + b[rows], return_inverse=True)
            held = np.bincount(inverse, weights=weight[rows])
            add[rows[held[inverse] > 1]] |= np.uint64(1) << np.uint64(w)
        found[open_rows] |= add
    return out | found[name]


def copies(payloads: list[bytes], blocks: list[int]) -> list[bytes]:
    """For each digest: 0 if it stands alone, 1 in the block that stands for it, 2 in the others.

    A payload is digests of 16 bytes, each with a byte that says if it repeats within the block.
    """
    seen: dict[bytes, list[int]] = {}
    for p, block in zip(payloads, blocks, strict=True):
        data = bytes(p)
        for at in range(0, len(data), 17):
            entry = seen.setdefault(data[at : at + 16], [block, 0])
            entry[0] = min(entry[0], block)
            entry[1] += 1 + data[at + 16]
    out = []
    for p, block in zip(payloads, blocks, strict=True):
        data = bytes(p)
        found = (seen[data[at : at + 16]] for at in range(0, len(data), 17))
        out.append(bytes(0 if n < 2 else 1 if least == block else 2 for least, n in found))
    return out


class Block:
    """One block's documents, as steps 1 to 3 see them."""

    def __init__(self, row: dict, cover: np.ndarray, buckets: int) -> None:
        self.cover, self.buckets = cover, buckets
        self.docs = [(key, np.frombuffer(text, np.uint8), hashlib.blake2b(text, digest_size=16).digest() if len(text) >= WIDTH else b"") for _, key, text in documents_of(row)]
        self.digests: dict[bytes, int] = {}
        for _, _, digest in self.docs:
            if digest:
                self.digests[digest] = self.digests.get(digest, 0) + 1

    def sampled(self) -> tuple[Numbered, list[np.ndarray]]:
        places = [samples(len(data), self.cover) for _, data, _ in self.docs]
        found = [names(data, at, WIDTH - PERIOD + 1, FIRST) for (_, data, _), at in zip(self.docs, places, strict=True)]
        first = np.concatenate(found) if found else np.empty(0, np.uint64)
        return Numbered(first, first, self.buckets), places

    def emit_samples(self) -> Iterator[tuple[int, bytes]]:
        numbered, _ = self.sampled()
        yield from numbered.payloads(numbered.twice)
        dealt: dict[int, list[bytes]] = {}
        for digest, n in self.digests.items():
            dealt.setdefault(self.home(digest), []).append(digest + bytes([n > 1]))
        for b, found in dealt.items():
            yield self.buckets + b, b"".join(found)

    def home(self, digest: bytes) -> int:
        return int.from_bytes(digest[:4], "big") * self.buckets >> 32

    def roles(self, answers: dict[int, bytes]) -> dict[bytes, int]:
        dealt: dict[int, list[bytes]] = {}
        for digest in self.digests:
            dealt.setdefault(self.home(digest), []).append(digest)
        return {d: r for b, ds in dealt.items() for d, r in zip(ds, answers[self.buckets + b], strict=True)}

    def suffixes(self, answers: dict[int, bytes]) -> tuple[Numbered, list[np.ndarray | None], np.ndarray, dict[bytes, int]]:
        """The suffixes that may tie: their names, starts by document (None: a copy of another)."""
        numbered, places = self.sampled()
        tied = numbered.repeated(answers)
        roles, seen = self.roles(answers), set()
        starts: list[np.ndarray | None] = []
        first, second, known, at = [], [], [], 0
        for (_, data, digest), where in zip(self.docs, places, strict=True):
            hits = where[tied[at : at + len(where)]]
            at += len(where)
            role = roles.get(digest, 0)
            if role == 2 or (role == 1 and digest in seen):
                starts.append(None)
                continue
            seen.add(digest)
            last = len(data) - WIDTH
            if last < 0 or not len(hits):
                starts.append(np.empty(0, np.int64))
                continue
            change = np.zeros(last + 2, np.int32)
            np.add.at(change, np.minimum(np.maximum(hits - PERIOD + 1, 0), last + 1), 1)
            np.add.at(change, np.minimum(hits + 1, last + 1), -1)
            mine = np.flatnonzero(np.cumsum(change[:-1]) > 0)
            starts.append(mine)
            first.append(names(data, mine, WIDTH, FIRST))
            second.append(names(data, mine, WIDTH, SECOND))
            known.append(np.full(len(mine), role == 1))
        join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
        return Numbered(join(first, np.uint64), join(second, np.uint64), self.buckets), starts, join(known, bool), roles

    def emit_suffixes(self, answers: dict[int, bytes]) -> Iterator[tuple[int, bytes]]:
        numbered, _, known, _ = self.suffixes(answers)
        flags = numbered.twice.copy()
        np.logical_or.at(flags, numbered.inverse[known], True)
        yield from numbered.payloads(flags)

    def survivors(self, answers: dict[int, bytes], replies: dict[int, bytes]) -> tuple[list[np.ndarray | None], dict[bytes, int]]:
        """By document, the suffixes whose names stand elsewhere too (None: a copy of another)."""
        numbered, starts, _, roles = self.suffixes(answers)
        tied, at, out = numbered.repeated(replies), 0, []
        for mine in starts:
            out.append(None if mine is None else mine[tied[at : at + len(mine)]])
            at += 0 if mine is None else len(mine)
        return out, roles

    def rows(self, starts: list[np.ndarray | None], roles: dict[bytes, int]) -> tuple[dict[int, dict[bytes, bool]], list[list[tuple[int, bytes, int]]]]:
        """Each bucket's distinct rows and if they repeat, and by document (bucket, row, place)."""
        dealt: dict[int, dict[bytes, bool]] = {}
        made: list[list[tuple[int, bytes, int]]] = []
        for (_, data, digest), mine in zip(self.docs, starts, strict=True):
            of: list[tuple[int, bytes, int]] = []
            if mine is not None:
                copied = bool(roles.get(digest))
                for core, row, place, _ in grouped(data, mine):
                    b = xxhash.xxh64_intdigest(core) * self.buckets >> 64
                    bucket = dealt.setdefault(b, {})
                    bucket[row] = copied or row in bucket
                    of.append((b, row, place))
            made.append(of)
        return dealt, made

    def emit_rows(self, answers: dict[int, bytes], replies: dict[int, bytes]) -> Iterator[tuple[int, bytes]]:
        for b, found in self.rows(*self.survivors(answers, replies))[0].items():
            yield b, packed_rows(found)

    def results(self, answers: dict[int, bytes], replies: dict[int, bytes], verdicts: dict[int, bytes]) -> Iterator[tuple]:
        """(id, bytes, kept bytes, number of spans) of each document."""
        starts, roles = self.survivors(answers, replies)
        dealt, made = self.rows(starts, roles)
        tied = {b: dict(zip(found, np.frombuffer(verdicts[b], "<u8").tolist(), strict=True)) for b, found in dealt.items()}
        for (key, data, digest), of in zip(self.docs, made, strict=True):
            flags = [(place, tied[b][row]) for b, row, place in of]
            if roles.get(digest):
                yield key, data, b"", 1
                continue
            change = np.zeros(len(data) + 1, np.int32)
            for place, bits in flags:
                while bits:
                    low = (bits & -bits).bit_length() - 1
                    run = ((~(bits >> low)) & -(~(bits >> low))).bit_length() - 1
                    change[place + low] += 1
                    change[place + low + run - 1 + WIDTH] -= 1
                    bits &= ~(((1 << run) - 1) << low)
            gone = np.cumsum(change[:-1]) > 0
            if gone.any():
                runs = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                yield key, data, data[~gone].tobytes(), runs
            else:
                yield key, data, data.tobytes(), 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int | None = None) -> DataFrame:
    """One row per document: the id, ``kept`` (its remaining bytes), ``n_bytes`` and ``n_spans``."""
    blocks = block_table(docs, id_col, text_col, block_bytes)
    buckets, cover = bucket_count(blocks), np.array(difference_cover(ORDER), np.int64)

    def emit_samples(row: dict) -> Iterator[tuple[int, bytes]]:
        return Block(row, cover, buckets).emit_samples()

    def rank(bucket: int, payloads: list[bytes], of: list[int]) -> tuple[list[bytes], int]:
        return (ties(payloads) if bucket < buckets else copies(payloads, of)), 0

    ranks, _ = exchange(blocks, emit_samples, rank, "ranks")

    def emit_suffixes(row: dict) -> Iterator[tuple[int, bytes]]:
        return Block(row, cover, buckets).emit_suffixes(answers_of(row, "ranks"))

    named, _ = exchange(joined(blocks, ranks), emit_suffixes, lambda _, p, __: (ties(p), 0), "suffixes")

    def emit_rows(row: dict) -> Iterator[tuple[int, bytes]]:
        return Block(row, cover, buckets).emit_rows(answers_of(row, "ranks"), answers_of(row, "suffixes"))

    sorted_buckets, _ = exchange(joined(blocks, ranks, named), emit_rows, lambda _, p, __: (sorted_ties(p), 0), "rows")
    kind = blocks.schema["ids"].dataType.elementType
    arrow = to_arrow_type(kind)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            out = list(Block(row, cover, buckets).results(answers_of(row, "ranks"), answers_of(row, "suffixes"), answers_of(row, "rows")))
            yield pa.RecordBatch.from_pydict({
                id_col: pa.array([r[0] for r in out], arrow),
                "kept": pa.array([r[2] for r in out], pa.binary()),
                "n_bytes": pa.array([len(r[1]) for r in out], pa.int64()),
                "n_spans": pa.array([r[3] for r in out], pa.int64()),
            })

    return joined(blocks, ranks, named, sorted_buckets).mapInArrow(finish, f"`{id_col}` {kind.simpleString()}, kept binary, n_bytes long, n_spans long")


def repeat_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`remove_repeats` as counts and the digest of what is left."""
    out = remove_repeats(docs, id_col, text_col)
    return out.select(id_col, "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
