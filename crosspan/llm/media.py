"""Media columns: AVI motion-JPEG.

:func:`to_avi` keeps bytes as 24 x 24 grey intra frames. A byte is a quantised DCT coefficient, the
unit that baseline JPEG codes without loss: bytes are the 256 values of magnitude category 8, whose
extra bits are the byte itself. Each block of 64 is a restart interval, so the first coefficient's
prediction is always 0. :func:`parse_avi` finds the frames by the RIFF index, :func:`decode` reads the
coefficients of any baseline grey JPEG by the Huffman tables of its header, all restart intervals of
many frames at a time, and :func:`shots` cuts where the histograms of the decoded pixels differ by more
than their recent course, giving timed clips.

Defined results: null and empty texts are one frame of padding; repeated rows and equal texts give
equal values; ids aren't used; an empty table gives no rows; other columns are not read. A text's file
is some 2.3 times its size and must stay below the 2 GiB of one binary value (texts up to 900 MB, whatever
their bytes up to 700 MB); a longer one raises ``ValueError``.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from crosspan.llm.common import text_of

SIDE, BLOCK, FPS, PAD = 24, 64, 25, 255
FRAME = SIDE * SIDE
LARGEST, FRAMES_AT_ONCE = (1 << 31) - (1 << 16), 2048
BLOCKS = FRAME // BLOCK
BINS, WINDOW, SHARPNESS, LEAST_CHANGE = 16, 12, 2.0, 0.5
#: The zigzag order of a block's coefficients: by anti-diagonals, turning at each.
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8)))

# ------------------------------------------------------------------------------------- encoding


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def huffman_table(kind: int, symbol: int) -> bytes:
    """A table with one code, eight zero bits, for ``symbol``."""
    return segment(0xC4, bytes([kind]) + bytes(1 if n == 8 else 0 for n in range(1, 17)) + bytes([symbol]))


HEAD = b"".join((
    b"\xff\xd8",
    segment(0xDB, b"\0" + bytes([1]) * 64),
    segment(0xC0, struct.pack(">BHHBBBB", 8, SIDE, SIDE, 1, 1, 0x11, 0)),
    huffman_table(0x00, 8),
    huffman_table(0x10, 8),
    segment(0xDD, struct.pack(">H", 1)),
    segment(0xDA, bytes([1, 1, 0, 0, 63, 0])),
))


def frames_of(payload: bytes) -> list[bytes]:
    """JPEG frames of a payload whose size is a multiple of FRAME."""
    n = len(payload) // FRAME
    data = np.frombuffer(payload, np.uint8).reshape(n, BLOCKS, BLOCK)
    coded = np.zeros((n, BLOCKS, 2 * BLOCK + 2), np.uint8)  # each byte after its code of zeros
    coded[:, :, 1 : 2 * BLOCK : 2] = data
    coded[:, :, -2] = 0xFF
    coded[:, :, -1] = 0xD0 + np.arange(BLOCKS) % 8
    coded[:, -1, -1] = 0xD9  # the end of the image stands where a restart would
    raw = coded.reshape(n, -1)
    full = (data == 0xFF).any(axis=(1, 2))
    out = []
    for k in range(n):
        if not full[k]:
            out.append(HEAD + raw[k].tobytes())
        else:
            blocks = (coded[k, j, :-2].tobytes().replace(b"\xff", b"\xff\0") + coded[k, j, -2:].tobytes() for j in range(BLOCKS))
            out.append(HEAD + b"".join(blocks))
    return out


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def to_avi(payload: bytes) -> bytes:
    """An AVI file of motion-JPEG frames with an idx1 index."""
    frames = frames_of(payload)
    if sum(map(len, frames)) + 26 * len(frames) >= LARGEST:
        raise ValueError(f"a text of {len(payload)} bytes is too long for one AVI file")
    largest = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, len(frames), 0, 1, largest, SIDE, SIDE, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, len(frames), largest, 0, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    header = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    body, index, at = [], [], 4
    for f in frames:
        c = chunk(b"00dc", f)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        body.append(c)
        at += len(c)
    riff = b"AVI " + header + chunk(b"LIST", b"movi" + b"".join(body)) + chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(riff)) + riff


# ------------------------------------------------------------------------------------- decoding


def riff_chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, size) of the chunks between two places."""
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        yield name, at + 8, size
        at += 8 + size + size % 2


def parse_avi(data: bytes) -> tuple[float, list[bytes]]:
    """(frames a second, JPEG frames) by the index; without one, in the order of the chunks."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    top = list(riff_chunks(data, 12, len(data)))
    movi = next(start for name, start, _ in top if name == b"LIST" and data[start : start + 4] == b"movi")
    rate = float(FPS)
    for name, start, size in top:
        if name == b"LIST" and data[start : start + 4] == b"hdrl":
            for inner, begin, _ in riff_chunks(data, start + 4, start + size):
                if inner == b"avih":
                    rate = 1e6 / struct.unpack_from("<I", data, begin)[0]
    index = next(((start, size) for name, start, size in top if name == b"idx1"), None)
    if index is None:
        size = next(size for name, start, size in top if start == movi)
        return rate, [data[s : s + n] for name, s, n in riff_chunks(data, movi + 4, movi + size) if name[2:] in (b"dc", b"db")]
    entries = np.frombuffer(data, "<u4", index[1] // 4, index[0]).reshape(-1, 4)
    base = movi if len(entries) and int(entries[0, 2]) < movi else 0  # offsets from 'movi', or from the file's start
    return rate, [data[base + o + 8 : base + o + 8 + n] for o, n in entries[:, 2:].tolist()]


@lru_cache(maxsize=64)
def parsed_head(head: bytes) -> tuple[dict, dict, tuple[int, int], int]:
    """(quantisation tables, Huffman tables, (height, width), restart interval) of a header.

    A Huffman table is two arrays over all 16 bits that can come next: the code's length (0: no such
    code) and its symbol.
    """
    quants: dict[int, np.ndarray] = {}
    codes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    shape, interval, at = (0, 0), 0, 2
    while at + 4 <= len(head):
        marker, size = head[at + 1], struct.unpack_from(">H", head, at + 2)[0]
        body = head[at + 4 : at + 2 + size]
        if marker == 0xDB:
            while body:
                wide = 2 if body[0] >> 4 else 1
                quants[body[0] & 15] = np.frombuffer(body, ">u2" if wide == 2 else np.uint8, 64, 1).astype(np.int64)
                body = body[1 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                lengths, symbols = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
                code = used = 0
                for length, n in enumerate(body[1:17], 1):
                    for _ in range(n):
                        span = slice(code << (16 - length), (code + 1) << (16 - length))
                        lengths[span], symbols[span] = length, body[17 + used]
                        code, used = code + 1, used + 1
                    code <<= 1
                codes[body[0]] = (lengths, symbols)
                body = body[17 + used :]
        elif marker == 0xC0:
            shape = struct.unpack_from(">HH", body, 1)
            if body[5] != 1:
                raise ValueError("only grey frames are decoded")
        elif marker in (0xC1, 0xC2, 0xC3):
            raise ValueError("only baseline frames are decoded")
        elif marker == 0xDD:
            interval = struct.unpack_from(">H", body)[0]
        at += 2 + size
    return quants, codes, shape, interval


def split_jpeg(jpeg: bytes) -> tuple[bytes, bytes]:
    """(header up to and with SOS, entropy-coded data with the EOI after it)."""
    at = 2
    while jpeg[at + 1] != 0xDA:
        at += 2 + struct.unpack_from(">H", jpeg, at + 2)[0]
    at += 2 + struct.unpack_from(">H", jpeg, at + 2)[0]
    return jpeg[:at], jpeg[at : jpeg.rindex(b"\xff\xd9") + 2]


class Bits:
    """Bit streams that are read side by side, each from its own place."""

    def __init__(self, data: np.ndarray, places: np.ndarray) -> None:
        padded = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.int64)
        #: 32 bits from each byte on.
        self.words = (padded[:-3] << 24) | (padded[1:-2] << 16) | (padded[2:-1] << 8) | padded[3:]
        self.places = places

    def ahead(self, who: np.ndarray) -> np.ndarray:
        """The next 16 bits of the streams ``who``."""
        at = self.places[who]
        return (self.words[at >> 3] >> (16 - (at & 7))) & 0xFFFF

    def symbol(self, who: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        bits = self.ahead(who)
        lengths = table[0][bits]
        if not lengths.all():
            raise ValueError("no such code")
        self.places[who] += lengths
        return table[1][bits]

    def extra(self, who: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The number that ``size`` more bits stand for."""
        value = self.ahead(who) >> (16 - size)
        self.places[who] += size
        return np.where((value << 1) >> size, value, value - (1 << size) + 1)


def scans(head: bytes, parts: list[bytes]) -> np.ndarray:
    """(frames, blocks, 64) quantised coefficients, in zigzag order, of frames with one header."""
    _, codes, (height, width), interval = parsed_head(head)
    total = -(-height // 8) * -(-width // 8)
    interval = interval or total
    raw = np.frombuffer(b"".join(parts), np.uint8)
    marks = np.flatnonzero(raw[:-1] == 0xFF)
    after = raw[marks + 1]
    ends = marks[(after >= 0xD0) & (after <= 0xD9)]  # a restart, or the end of the image
    keep = np.ones(len(raw), bool)
    keep[marks[after == 0] + 1] = False  # stuffed
    keep[ends] = keep[ends + 1] = False
    stop = (np.cumsum(keep) - keep)[ends]
    per_frame = -(-total // interval)
    if len(ends) != per_frame * len(parts):
        raise ValueError(f"{len(ends)} restart intervals in {len(parts)} frames, not {per_frame} in each")
    streams = Bits(raw[keep], np.concatenate([[0], stop[:-1]]) * 8)
    out = np.zeros((len(parts), per_frame * interval, 64), np.int16)
    flat = out.reshape(-1, 64)
    first = np.arange(len(ends)) * interval
    size = np.minimum(interval, total - np.arange(len(ends)) % per_frame * interval)
    previous = np.zeros(len(ends), np.int64)
    for block in range(interval):
        live = np.flatnonzero(block < size)
        previous[live] += streams.extra(live, streams.symbol(live, codes[0x00]))
        flat[first[live] + block, 0] = previous[live]
        k = np.ones(len(ends), np.int64)
        while len(live):
            symbol = streams.symbol(live, codes[0x10])
            live, symbol = live[symbol > 0], symbol[symbol > 0]
            k[live] += symbol >> 4
            valued = symbol & 15 > 0
            who = live[valued]
            if (k[who] > 63).any():
                raise ValueError("a coefficient beyond its block")
            flat[first[who] + block, k[who]] = streams.extra(who, symbol[valued] & 15)
            k[live] += 1
            live = live[k[live] < 64]
    return out[:, :total]


def decode(frames: list[bytes]) -> Iterator[np.ndarray]:
    """(frames, blocks, 64) coefficients, of runs of frames with the same header."""
    for head, run in groupby(map(split_jpeg, frames), key=lambda x: x[0]):
        parts = [part for _, part in run]
        for at in range(0, len(parts), FRAMES_AT_ONCE):
            yield scans(head, parts[at : at + FRAMES_AT_ONCE])


def bytes_of(coded: np.ndarray) -> bytes:
    """The bytes that coefficients of category 8 stand for."""
    return np.where(coded < 0, coded + 255, coded).astype(np.uint8).tobytes()


@lru_cache(maxsize=1)
def inverse_dct() -> np.ndarray:
    """(64, 64): pixels of a block from its coefficients in zigzag order."""
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    basis = np.cos((2 * x + 1) * k * np.pi / 16) * np.where(k, 0.5, np.sqrt(0.125))
    return np.einsum("ux,vy->uvxy", basis, basis).reshape(64, 64)[ZIGZAG].astype(np.float32)


def pixels(coded: np.ndarray) -> np.ndarray:
    """(frames, blocks, 64) grey values from 0 to 255."""
    values = coded.reshape(-1, 64).astype(np.float32) @ inverse_dct()
    return np.clip(np.rint(values + 128), 0, 255).astype(np.uint8).reshape(coded.shape)


def histograms(grey: np.ndarray) -> np.ndarray:
    """(frames, BINS) shares of the grey levels."""
    n = len(grey)
    at = (grey.reshape(n, -1) >> 4).astype(np.int32) + np.arange(n, dtype=np.int32)[:, None] * BINS
    return np.bincount(at.ravel(), minlength=n * BINS).reshape(n, BINS) / grey[0].size


def shots(levels: np.ndarray) -> list[tuple[int, int]]:
    """(first frame, end frame) of each shot.

    A cut is a difference above the mean of the WINDOW before it by SHARPNESS deviations, and
    LEAST_CHANGE at least.
    """
    change = np.abs(np.diff(levels, axis=0)).sum(axis=1)
    sums, squares = np.concatenate([[0], np.cumsum(change)]), np.concatenate([[0], np.cumsum(change**2)])
    at = np.arange(len(change))
    low = np.maximum(at - WINDOW, 0)
    n = np.maximum(at - low, 1)
    mean = (sums[at] - sums[low]) / n
    spread = np.sqrt(np.maximum((squares[at] - squares[low]) / n - mean**2, 0))
    cuts = (np.flatnonzero(change > np.maximum(mean + SHARPNESS * spread, LEAST_CHANGE)) + 1).tolist()
    return list(zip([0, *cuts], [*cuts, len(levels)], strict=True))


# ------------------------------------------------------------------------------------ operators


def payload_of(text: bytes) -> bytes:
    """The text and as many bytes PAD as make a positive number of whole frames."""
    size = max(1, -(-len(text) // FRAME)) * FRAME
    return text + bytes([PAD]) * (size - len(text))


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media): each text as an AVI file."""
    source = docs.select(docs[id_col], text_of(docs, text_col).cast("binary").alias("data"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                made, size, first = [], 0, at
                while at < batch.num_rows and size < 8 << 20:
                    made.append(to_avi(payload_of(batch.column(1)[at].as_py())))
                    size, at = size + len(made[-1]), at + 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, at - first), pa.array(made, pa.binary())], names=[id_col, "media"])

    return source.mapInArrow(encode, f"`{id_col}` {dict(source.dtypes)[id_col]}, media binary")


DECODED = "payload binary, media_bytes long, media_sha256 string, clips array<struct<first:long,end:long,start_s:double,end_s:double>>, peak double, padding long"


def decode_media(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(id, payload, size and digest of the file, timed clips, largest change, bytes of padding)."""
    source = media.select(media[id_col], media[media_col])
    kind = source.schema[id_col].dataType

    clip = pa.struct([("first", pa.int64()), ("end", pa.int64()), ("start_s", pa.float64()), ("end_s", pa.float64())])
    kinds = (pa.binary(), pa.int64(), pa.string(), pa.list_(clip), pa.float64(), pa.int64())
    names, arrow = [id_col, "payload", "media_bytes", "media_sha256", "clips", "peak", "padding"], to_arrow_type(kind)

    def rows(files: list[bytes]) -> Iterator[tuple]:
        """The files' results; the frames of all are decoded together."""
        parsed = [parse_avi(data) for data in files]
        parts, seen, sizes = [], [], []
        for coded in decode([f for _, frames in parsed for f in frames]):
            seen.append(histograms(pixels(coded)))
            parts.append(bytes_of(coded))
            sizes.append(np.full(len(coded), coded[0].size))
        whole, levels = b"".join(parts), np.concatenate(seen)
        ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).tolist()
        at = 0
        for data, (rate, frames) in zip(files, parsed, strict=True):
            mine, payload = levels[at : at + len(frames)], whole[ends[at] : ends[at + len(frames)]]
            at += len(frames)
            clips = [{"first": a, "end": b, "start_s": a / rate, "end_s": b / rate} for a, b in shots(mine)]
            peak = float(np.abs(np.diff(mine, axis=0)).sum(axis=1).max(initial=0.0))
            yield payload, len(data), hashlib.sha256(data).hexdigest(), clips, peak, len(payload) - len(payload.rstrip(bytes([PAD])))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                files, held, first = [], 0, at
                while at < batch.num_rows and held < 4 << 20:
                    files.append(batch.column(1)[at].as_py())
                    held, at = held + len(files[-1]), at + 1
                arrays = [pa.array(c, k) for c, k in zip(zip(*rows(files), strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(files)).cast(arrow), *arrays], names=names)

    return source.mapInArrow(read, f"`{id_col}` {kind.simpleString()}, {DECODED}")


def clip_rows(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per clip: id, clip number, first and end frame, start and end in seconds."""
    return decoded.select(id_col, F.posexplode("clips").alias("clip", "c")).select(id_col, "clip", "c.*")


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text through :func:`encode_media` and :func:`decode_media`, as digests."""
    d = decode_media(encode_media(docs, id_col, text_col), id_col)
    return d.select(
        id_col,
        (F.length("payload") - F.col("padding")).cast("long").alias("n_bytes"),
        "media_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, length(payload) - 31, 32)")).alias("tail_crc32"),
        "media_sha256",
        F.concat(F.lit("frames="), (F.length("payload") / FRAME).cast("long"), F.lit(";shots="), F.size("clips"), F.lit(";peak="), F.format_number("peak", 4), F.lit(";cuts="), F.crc32(F.array_join(F.transform("clips", lambda c: c["first"].cast("string")), ",").cast("binary"))).alias("feature"),
    )
