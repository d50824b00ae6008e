"""Prediction by partial matching over byte contexts, learned from the corpus.

The model is a trie of byte contexts up to ``ORDER`` bytes. A symbol's probability in a context is
its count less one half, over the context's total; the halves make up the escape (estimation of
method D). A symbol that the context hasn't seen costs the escape and is predicted by the next shorter context, from which the
symbols already offered are excluded; below order 0 what is left of the 256 bytes is uniform.

Counts come from all training documents. The trie is never gathered whole: blocks of documents send
their distinct (context, symbol) pairs with training counts to the bucket of the context's last two
bytes; a bucket therefore holds whole subtries, computes the code length of each pair, and answers
each block for its own pairs only. Two bytes before more than one symbol in ``HEAVY`` are split by the
third, so no bucket is bound to hold them. What is collected and sent to all are the counts of orders 1
and 0 (65,792) and those after heavy two bytes (fewer than ``HEAVY`` * 256), whatever the input. A base
model of words is scored by the same exchange.

A text is scored in its lower-cased form, words joined by single spaces, closed by an end symbol.

Defined results: null and empty texts consist of the end symbol alone; with no training documents
all symbols are uniform; repeated rows each count and each give a row; null ids are held in (their
fold is unknown); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from crosspan.llm.blocks import BLOCK_BYTES, answers_of, block_table, bucket_count, documents_of, exchange, joined, rows_of, scaled, sized
from crosspan.llm.common import written

ORDER, FOLDS, HELD = 5, 7, 2
END = 10  # closes a text and stands before its first symbol; normalised text has no other
START = bytes([END]) * ORDER
MASK = [np.uint64((1 << (8 * k)) - 1) for k in range(ORDER + 2)]
LARGEST_TABLE = 1 << 26
HEAVY = 1024
MODEL_BLOCK_BYTES = 2 * BLOCK_BYTES  # larger blocks repeat fewer grams


def is_held(key: object) -> bool:
    return key is not None and zlib.crc32(str(key).encode()) % FOLDS == HELD


def normal(text: bytes) -> bytes:
    return b" ".join(text.lower().split())


def grams(seq: np.ndarray) -> np.ndarray:
    """At each place from ORDER on: the ORDER bytes before it and its own, as one number."""
    out = np.zeros(len(seq) - ORDER, np.uint64)
    for k in range(ORDER + 1):
        out <<= np.uint64(8)
        out |= seq[k : len(seq) - ORDER + k]
    return out


def coded(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code of each place's gram, gram of each code).

    Grams grow by a byte at a time; each length's grams get dense numbers from a table of flags,
    which is far faster than a sort. Where the table would be too large, a sort does it.
    """
    symbols = np.flatnonzero(np.bincount(seq, minlength=256))
    to = np.zeros(256, np.int32)
    to[symbols] = np.arange(len(symbols))
    small = to[seq]
    code, gram = small, symbols.astype(np.uint64)
    for k in range(1, ORDER + 1):
        if len(gram) * len(symbols) > LARGEST_TABLE:
            gram, code = np.unique(grams(seq), return_inverse=True)
            return code, gram
        code = code[:-1] * np.int32(len(symbols)) + small[k:]
        seen = np.zeros(len(gram) * len(symbols), bool)
        seen[code] = True
        used = np.flatnonzero(seen)
        gram = gram[used // len(symbols)] << np.uint64(8) | symbols[used % len(symbols)].astype(np.uint64)
        code = (np.cumsum(seen, dtype=np.int32) - np.int32(1))[code]
    return code, gram


class Text:
    """A block's normalised texts as one sequence, and where each one's symbols are."""

    def __init__(self, row: dict) -> None:
        self.ids, texts = [], []
        for _, key, text in documents_of(row):
            self.ids.append(key)
            texts.append(normal(text))
        self.texts = texts
        self.held = np.array([is_held(k) for k in self.ids], bool)
        self.seq = np.frombuffer(b"".join(START + t + START[:1] for t in texts), np.uint8)
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        self.starts = np.cumsum(sizes + ORDER) - sizes - ORDER  # of a text's first symbol, in places
        self.sizes = sizes

    def coded(self) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the texts' symbols, one text after another, and the gram of each code."""
        code, gram = coded(self.seq)
        inside = np.zeros(len(code) + 1, np.int32)
        np.add.at(inside, self.starts, 1)
        np.add.at(inside, self.starts + self.sizes, -1)
        code = code[np.cumsum(inside[:-1]) > 0]
        used = np.flatnonzero(np.bincount(code, minlength=len(gram)))
        back = np.zeros(len(gram), np.int64)
        back[used] = np.arange(len(used))
        return back[code], gram[used]

    def words(self) -> tuple[dict[bytes, int], list[np.ndarray]]:
        """Numbers of the block's distinct tokens (the end is b""), and each text's tokens."""
        vocabulary: dict[bytes, int] = {b"": 0}
        out = []
        for t in self.texts:
            tokens = t.split(b" ") if t else []
            out.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in tokens), np.int64, len(tokens)))
        return vocabulary, out


def hashes(words: dict[bytes, int]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


class Low:
    """Training counts of low orders: of all contexts below order 2, of the heavy ones at order 2."""

    def __init__(self, pairs: np.ndarray, heavy: np.ndarray, after: np.ndarray) -> None:
        #: ``heavy``: sorted contexts of two bytes; ``after``: the counts of each symbol after them.
        self.heavy = heavy
        self.tables = (pairs.sum(axis=0)[None, :], pairs, after)

    def rows(self, k: int, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which contexts of order k have a row in ``tables[k]``, and the row."""
        if k > 2 or (k == 2 and not len(self.heavy)):
            return np.zeros(len(contexts), bool), np.zeros(len(contexts), np.int64)
        if k < 2:
            return np.ones(len(contexts), bool), contexts.astype(np.int64)
        at = np.minimum(np.searchsorted(self.heavy, contexts), len(self.heavy) - 1)
        return self.heavy[at] == contexts, at

    def buckets_of(self, gram: np.ndarray, buckets: int) -> np.ndarray:
        """The bucket of each gram, by the last two bytes of its context, or three if two are heavy."""
        two = (gram >> np.uint64(8)) & np.uint64(0xFFFF)
        mixed = np.where(self.rows(2, two)[0], (gram >> np.uint64(8)) & np.uint64(0xFFFFFF) | np.uint64(1 << 24), two)
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        return scaled(mixed * np.uint64(0xBF58476D1CE4E5B9), buckets)


def dealt(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by bucket, and the bounds of each bucket in it."""
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def packed_grams(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """A gram's bytes, then four for its count."""
    return np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, : ORDER + 1]).tobytes() + counts.astype(np.uint32).tobytes()


def unpacked_grams(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // (ORDER + 5)
    wide = np.zeros((n, 8), np.uint8)
    wide[:, : ORDER + 1] = np.frombuffer(data, np.uint8, (ORDER + 1) * n).reshape(n, ORDER + 1)
    return wide.view(np.uint64).ravel(), np.frombuffer(data, np.uint8, offset=(ORDER + 1) * n).view(np.uint32).astype(np.int64)


def code_lengths(keys: np.ndarray, counts: np.ndarray, low: Low) -> np.ndarray:
    """log10 probability of each gram's symbol in its context.

    ``keys`` (distinct, sorted) and ``counts`` must hold all grams of every context that ``low`` lacks.
    """
    result = np.zeros(len(keys))
    found = np.zeros(len(keys), bool)
    #: Of the next higher order: each gram's context, first grams of the symbols offered, numbers of
    #: distinct symbols, contexts, and where ``low`` has them.
    above: tuple | None = None
    symbol = (keys & np.uint64(255)).astype(np.int64)
    for k in range(ORDER, -1, -1):
        nodes, back = np.unique(keys & MASK[k + 1], return_inverse=True)
        contexts, at = np.unique(nodes >> np.uint64(8), return_inverse=True)
        total = np.bincount(back, weights=counts).astype(np.int64)
        n = np.bincount(at, weights=total)
        d = np.bincount(at, weights=total > 0)
        own, place = total[back], at[back]
        known, row = low.rows(k, contexts)
        if known.any():
            table = low.tables[k][row[known]]
            n[known], d[known] = table.sum(axis=1), (table > 0).sum(axis=1)
            mine = known[place]
            own[mine] = low.tables[k][row[place[mine]], symbol[mine]]
        if above is None:
            n_left, d_left = n[place], d[place]
        else:
            # Exclusion: what the next higher context offers is taken out of this one's counts.
            up_place, up_first, up_d, up_contexts, up_known, up_row = above
            offered = np.zeros(len(up_d))
            here = up_first[~up_known[up_place[up_first]]]
            np.add.at(offered, up_place[here], own[here])
            if up_known.any():  # it may offer symbols that these grams lack
                parent = low.rows(k, up_contexts[up_known] & MASK[k])[1]
                offered[up_known] = ((low.tables[k + 1][up_row[up_known]] > 0) * low.tables[k][parent]).sum(axis=1)
            n_left = n[place] - offered[up_place]
            d_left = d[place] - up_d[up_place]
        alive = ~found
        hit = alive & (own > 0)
        result[hit] += np.log10((2 * own[hit] - 1) / (2 * n_left[hit]))
        found |= hit
        miss = alive & ~hit & (n_left > 0)
        result[miss] += np.log10(d_left[miss] / (2 * n_left[miss]))
        # One gram of each symbol that this order offers in each context.
        seen = own > 0
        pairs = place.astype(np.int64) << 8 | symbol
        _, first = np.unique(pairs, return_index=True)
        above = (place, first[seen[first]], d, contexts, known, row)
    rest = ~found
    result[rest] -= np.log10(256 - np.count_nonzero(low.tables[0]))
    return result


def low_orders(blocks: DataFrame) -> tuple[Low, int]:
    """Counts of low orders and the number of tokens of the training texts."""
    end = np.int64(END)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        triples, tokens = np.zeros(1 << 24, np.int64), 0
        for row in rows_of(batches):
            texts = [normal(text) for _, key, text in documents_of(row) if not is_held(key)]
            tokens += sum(1 + (t.count(b" ") + 1 if t else 0) for t in texts)
            seq = np.frombuffer(b"".join(START[:2] + t + START[:1] for t in texts), np.uint8)
            if not len(seq):
                continue
            symbols = np.flatnonzero(np.bincount(seq, minlength=256))
            to = np.zeros(256, np.int32)
            to[symbols] = np.arange(len(symbols))
            small, wide = to[seq], len(symbols)
            seen = np.bincount((small[:-2] * wide + small[1:-1]) * wide + small[2:], minlength=wide**3)
            used = np.flatnonzero(seen)
            code = (symbols[used // wide**2] << 16) | (symbols[used // wide % wide] << 8) | symbols[used % wide]
            # Two ends in a row at the end of a triple stand between texts, but for empty texts.
            inside = (code & 0xFFFF) != (end << 8 | end)
            triples[code[inside]] += seen[used[inside]]
            triples[end << 16 | end << 8 | end] += sum(not t for t in texts)
        used = np.flatnonzero(triples)
        yield pa.RecordBatch.from_pydict({"triple": pa.array([*used.tolist(), -1], pa.int32()), "n": pa.array([*triples[used].tolist(), tokens], pa.int64())})

    made = blocks.select("ids", "sizes", "data").mapInArrow(count, "triple int, n long")
    triples = written(made.groupBy("triple").agg(F.sum("n").alias("n")), "triples")
    pairs = np.zeros(1 << 16, np.int64)
    for r in triples.where("triple >= 0").groupBy(F.expr("triple & 65535").alias("pair")).agg(F.sum("n").alias("n")).collect():  # at most 65,536 rows
        pairs[r.pair] = r.n
    tokens = triples.where("triple < 0").agg(F.sum("n")).first()[0] or 0
    # Fewer than HEAVY contexts can hold more than one symbol in HEAVY each.
    found = triples.where("triple >= 0").groupBy(F.expr("shiftright(triple, 8)").alias("two")).agg(F.sum("n").alias("n"))
    heavy = np.array(sorted(r.two for r in found.where(F.col("n") * HEAVY > int(pairs.sum())).collect()), np.uint64)
    after = np.zeros((len(heavy), 256), np.int64)
    if len(heavy):
        rows = triples.where(F.expr("shiftright(triple, 8)").isin(heavy.tolist())).collect()
        for r in rows:  # fewer than HEAVY * 256
            after[np.searchsorted(heavy, np.uint64(r.triple >> 8)), r.triple & 255] = r.n
    return Low(pairs.reshape(256, 256), heavy, after), tokens


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int | None = None) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes.

    Documents of the fold crc32(id) mod 7 = 2 are scored by a model that hasn't seen them.
    """
    blocks = block_table(docs, id_col, text_col, block_bytes or sized(docs, text_col, MODEL_BLOCK_BYTES))
    buckets = bucket_count(blocks)
    low, tokens = low_orders(blocks)

    def emit(row: dict) -> Iterator[tuple[int, bytes]]:
        text = Text(row)
        code, gram = text.coded()
        trained = np.repeat(~text.held, text.sizes)
        counts = np.bincount(code[trained], minlength=len(gram))
        order, edges = dealt(low.buckets_of(gram, buckets), buckets)
        for b in np.flatnonzero(np.diff(edges)):
            part = order[edges[b] : edges[b + 1]]
            yield int(b), packed_grams(gram[part], counts[part])
        vocabulary, by_text = text.words()
        mine = [t for t, h in zip(by_text, text.held, strict=True) if not h]
        counts = np.bincount(np.concatenate(mine) if mine else np.empty(0, np.int64), minlength=len(vocabulary))
        counts[0] = len(mine)
        keys = hashes(vocabulary)
        order, edges = dealt(scaled(keys, buckets), buckets)
        for b in np.flatnonzero(np.diff(edges)):
            part = order[edges[b] : edges[b + 1]]
            yield buckets + int(b), keys[part].tobytes() + counts[part].astype(np.uint32).tobytes()

    def answer(bucket: int, payloads: list[bytes], _: list[int]) -> tuple[list[bytes], int]:
        if bucket < buckets:
            parts = [unpacked_grams(p) for p in payloads]
        else:
            parts = [(np.frombuffer(p, np.uint64, len(p) // 12), np.frombuffer(p, np.uint8, offset=len(p) // 12 * 8).view(np.uint32).astype(np.int64)) for p in payloads]
        edges = np.cumsum([0, *(len(k) for k, _ in parts)])
        keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        counts = np.bincount(back, weights=np.concatenate([c for _, c in parts])).astype(np.int64)
        if bucket < buckets:
            made, distinct = code_lengths(keys, counts, low).astype(np.float32)[back], 0
        else:
            made, distinct = counts[back], int(np.count_nonzero(counts))
        return [made[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], distinct

    answers, distinct = exchange(blocks, emit, answer, "model")
    kind = blocks.schema["ids"].dataType.elementType
    arrow = to_arrow_type(kind)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            text, got = Text(row), answers_of(row, "model")
            code, gram = text.coded()
            length = np.empty(len(gram))
            order, edges = dealt(low.buckets_of(gram, buckets), buckets)
            for b in np.flatnonzero(np.diff(edges)):
                length[order[edges[b] : edges[b + 1]]] = np.frombuffer(got[int(b)], np.float32)
            score = np.add.reduceat(length[code], np.cumsum(text.sizes) - text.sizes)
            vocabulary, by_text = text.words()
            counts = np.empty(len(vocabulary), np.int64)
            order, edges = dealt(scaled(hashes(vocabulary), buckets), buckets)
            for b in np.flatnonzero(np.diff(edges)):
                counts[order[edges[b] : edges[b + 1]]] = np.frombuffer(got[buckets + int(b)], np.int64)
            logs = np.log10(counts + 1.0) - np.log10(float(tokens + distinct + 1))
            known = counts > 0
            yield pa.RecordBatch.from_pydict({
                id_col: pa.array(text.ids, arrow),
                "held_out": pa.array(text.held.tolist(), pa.bool_()),
                "n_tokens": pa.array([len(t) + 1 for t in by_text], pa.int64()),
                "n_known": pa.array([int(known[t].sum() + known[0]) for t in by_text], pa.int64()),
                "train_tokens": pa.array([tokens] * len(text.ids), pa.int64()),
                "base_score": pa.array([float(logs[t].sum() + logs[0]) for t in by_text], pa.float64()),
                "score": pa.array(score, pa.float64()),
                "n_bytes": pa.array(text.sizes - 1, pa.int64()),
            })

    schema = f"`{id_col}` {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"
    return joined(blocks, answers).mapInArrow(finish, schema)


def code_length_summary(scored: DataFrame) -> pd.DataFrame:
    """Bits per byte of held-in and held-out documents."""
    bits = -F.sum("score") / F.log10(F.lit(2.0)) / F.sum(F.col("n_bytes") + 1)
    return scored.groupBy("held_out").agg(bits.alias("bits_per_byte"), (F.sum("score") / F.sum("base_score")).alias("of_base")).toPandas()
