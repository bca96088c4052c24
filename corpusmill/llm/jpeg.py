"""Media columns: progressive JPEG written, read scan by scan, and turned into RGB tensors.

A text's padded bytes are stored as the quantized DCT coefficients of a 4:2:0
progressive JPEG, in the order luma, blue and red chroma, block by block in
zigzag order; a byte b is the coefficient b + 2, so that none is zero.  The
file has seven scans: DC to all but its last bit, two AC bands of luma to all but
their last bit, one whole AC band for each chroma, and the refinements of DC and luma.  Its Huffman tables give a category and its extra bits one total
width, so whole scans are coded and decoded as arrays; a file with other tables
is decoded bit by bit, by the same accumulation of scans into coefficients.

Decoding accumulates spectral selection and successive approximation into
coefficient arrays, inverse-transforms them in numpy, doubles the chroma planes
and gives a full-resolution RGB tensor.

Defined results: null and empty text are one chunk of 255s; repeated rows and
equal texts have equal values; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm.common import batches, id_and_bytes, raw_values, stage, table

CHUNK, FILL, SHIFT = 576, 255, 2

# Fixed values of the format: the zigzag order follows from a rule, the markers are the standard's.
SOI, EOI, SOF2, DHT, DQT, SOS, DRI, COM = 0xD8, 0xD9, 0xC2, 0xC4, 0xDB, 0xDA, 0xDD, 0xFE
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8)))
#: Components of 4:2:0: (id, horizontal, vertical sampling).
PARTS = ((1, 2, 2), (2, 1, 1), (3, 1, 1))
#: Scans: components, first and last coefficient, high and low bit of successive approximation.
SCANS = (
    ((0, 1, 2), 0, 0, 0, 1),
    ((0,), 1, 5, 0, 1),
    ((0,), 6, 63, 0, 1),
    ((1,), 1, 63, 0, 0),
    ((2,), 1, 63, 0, 0),
    ((0, 1, 2), 0, 0, 1, 0),
    ((0,), 1, 63, 1, 0),
)
DC_WIDTH, AC_WIDTH = 10, 10

_u, _x = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
_COSINE = (np.where(_u == 0, 0.5**0.5, 1.0) / 2 * np.cos((2 * _x + 1) * _u * np.pi / 16)).astype(np.float32)
#: From 64 zigzag coefficients to 64 samples, one matrix.
_INVERSE = np.kron(_COSINE, _COSINE)[ZIGZAG]


def _tables(width: int, categories: range, low: int) -> tuple[list[int], bytes]:
    """Code lengths and symbols of a Huffman table in which length plus extra bits is ``width``."""
    lengths = [0] * 16
    symbols = []
    for c in sorted(categories, reverse=True):
        lengths[width - c - 1] += 1
        symbols.append(c + low)
    return lengths, bytes(symbols)


#: DC differences have categories 0 to 8, AC values 1 to 9; refinement scans know end-of-band only.
DC_TABLE = _tables(DC_WIDTH, range(0, 10), 0)
AC_TABLE = _tables(AC_WIDTH, range(1, 10), 0)
EOB_TABLE = ([1] + [0] * 15, bytes([0]))


def _codes(table_: tuple[list[int], bytes]) -> dict[tuple[int, int], int]:
    """(length, code) -> symbol, by the standard's rule of consecutive codes."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(table_[0], 1):
        for _ in range(n):
            out[length, code] = table_[1][at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _value_words(width: int, table_: tuple[list[int], bytes], bound: int) -> np.ndarray:
    """For each value -bound..bound the ``width`` bits that code it."""
    code = {s: (length, c) for (length, c), s in _codes(table_).items()}
    out = np.zeros(2 * bound + 1, np.uint16)
    for v in range(-bound, bound + 1):
        size = abs(v).bit_length()
        if size in code:
            _, c = code[size]
            out[v + bound] = c << size | (v if v >= 0 else v + (1 << size) - 1)
    return out


def _words_value(words: np.ndarray, width: int, zero: bool) -> np.ndarray:
    """The inverse, for every pattern of ``width`` bits."""
    bound = (len(words) - 1) // 2
    out = np.zeros(1 << width, np.int16)
    for v in range(-bound, bound + 1):
        if v or zero:
            out[words[v + bound]] = v
    return out


_DC_WORDS, _AC_WORDS = _value_words(DC_WIDTH, DC_TABLE, 511), _value_words(AC_WIDTH, AC_TABLE, 511)
_DC_VALUES, _AC_VALUES = _words_value(_DC_WORDS, DC_WIDTH, True), _words_value(_AC_WORDS, AC_WIDTH, False)


def _stuffed(raw: bytes) -> bytes:
    return raw.replace(b"\xff", b"\xff\x00")


def _to_bytes(words: np.ndarray, width: int) -> bytes:
    """Values of 9 or 10 bits as an entropy-coded segment: ones at the end, a zero after each 255.

    Eight values fill ``width`` bytes, so every byte of such a group is a shift of two values.
    """
    n = len(words)
    full = np.full((-(-n // 8), 8), (1 << width) - 1, np.uint32)
    full.ravel()[:n] = words
    out = np.empty((len(full), width), np.uint8)
    for k in range(width):
        first, last = 8 * k // width, (8 * k + 7) // width
        end = (first + 1) * width - 8 * k  # bits of the first value from this byte on
        out[:, k] = full[:, first] >> (end - 8) if first == last else full[:, first] << (8 - end) | full[:, last] >> (width - 8 + end)
    return _stuffed(out.tobytes()[: -(-n * width // 8)])


def _bits_to_bytes(bits: np.ndarray) -> bytes:
    """Single bits as an entropy-coded segment."""
    pad = -bits.size % 8
    bits = bits.ravel()
    return _stuffed(np.packbits(np.concatenate([bits, np.ones(pad, np.uint8)]) if pad else bits).tobytes())


def _from_bytes(raw: bytes, width: int, count: int) -> np.ndarray:
    """The first ``count`` values of 9 or 10 bits of an entropy-coded segment."""
    raw = raw.replace(b"\xff\x00", b"\xff")
    groups = -(-count // 8)
    a = np.frombuffer(raw.ljust(groups * width, b"\xff"), np.uint8).reshape(groups, width)
    out = np.empty((groups, 8), np.uint16)
    mask = (1 << width) - 1
    for j in range(8):
        at, off = divmod(j * width, 8)
        pair = a[:, at].astype(np.uint16) << 8
        pair |= a[:, at + 1]
        out[:, j] = pair >> (16 - width - off) & mask
    return out.ravel()[:count]


def _bits_from_bytes(raw: bytes, count: int) -> np.ndarray:
    """The first ``count`` bits of an entropy-coded segment."""
    return np.unpackbits(np.frombuffer(raw.replace(b"\xff\x00", b"\xff"), np.uint8), count=count)


def grid(blocks: int) -> tuple[int, int]:
    """(columns, rows) of the 16 x 16 units that hold so many blocks, six to a unit."""
    units = ceil(blocks / 6)
    across = max(1, isqrt(units - 1) + 1)
    return across, ceil(units / across)


def _mcu_order(across: int, down: int) -> np.ndarray:
    """Luma blocks of each unit, as numbers in the raster order of blocks."""
    unit = np.arange(across * down)
    row, col = unit // across * 2, unit % across * 2
    return np.stack([(row + dy) * across * 2 + col + dx for dy in (0, 1) for dx in (0, 1)], 1)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _huffman(kind: int, number: int, table_: tuple[list[int], bytes]) -> bytes:
    return _segment(DHT, bytes([kind << 4 | number, *table_[0]]) + table_[1])


def encode(payload: bytes) -> bytes:
    """A progressive JPEG whose coefficients are the payload's bytes."""
    blocks = ceil(len(payload) / 64)
    across, down = grid(blocks)
    units = across * down
    c = np.full(units * 6 * 64, SHIFT, np.int16)
    c[: len(payload)] = np.frombuffer(payload, np.uint8).astype(np.int16) + SHIFT
    c = c.reshape(-1, 64)
    parts = [c[: units * 4], c[units * 4 : units * 5], c[units * 5 :]]
    order = _mcu_order(across, down)
    out = [b"\xff\xd8", _segment(DQT, bytes([0]) + bytes([1] * 64))]
    frame = struct.pack(">BHHB", 8, down * 16, across * 16, 3) + b"".join(bytes([i, h << 4 | v, 0]) for i, h, v in PARTS)
    out += [_segment(SOF2, frame), _segment(COM, struct.pack(">Q", len(payload)))]
    for which, first, last, high, low in SCANS:
        if first == 0:
            kind, table_ = 0, DC_TABLE
            inter = np.concatenate([parts[0][order, 0], parts[1][:, :1], parts[2][:, :1]], 1)
            if high:
                body = _bits_to_bytes((inter & 1).astype(np.uint8))
            else:
                up = inter >> low
                y = np.diff(up[:, :4].ravel(), prepend=0).reshape(-1, 4)
                d = np.concatenate([y, np.diff(up[:, 4], prepend=0)[:, None], np.diff(up[:, 5], prepend=0)[:, None]], 1)
                body = _to_bytes(_DC_WORDS[d.ravel() + 511], DC_WIDTH)
        else:
            kind, band = 1, parts[which[0]][:, first : last + 1]
            if high:
                table_ = EOB_TABLE
                bits = np.zeros((len(band), band.shape[1] + 1), np.uint8)
                bits[:, 1:] = band & 1
                body = _bits_to_bytes(bits)
            else:
                table_ = AC_TABLE
                body = _to_bytes(_AC_WORDS[(band >> low).ravel() + 511], AC_WIDTH)
        if not (first == 0 and high):
            out.append(_huffman(kind, 0, table_))
        selector = bytes([len(which)]) + b"".join(bytes([PARTS[k][0], 0]) for k in which)
        out += [_segment(SOS, selector + bytes([first, last, high << 4 | low])), body]
    return b"".join([*out, b"\xff\xd9"])


class _Bits:
    """Bit reader of one entropy-coded segment."""

    def __init__(self, raw: bytes):
        self.bits = np.unpackbits(np.frombuffer(raw.replace(b"\xff\x00", b"\xff"), np.uint8)).tolist()
        self.at = 0

    def take(self, n: int) -> int:
        v = 0
        for _ in range(n):
            v = v << 1 | (self.bits[self.at] if self.at < len(self.bits) else 1)
            self.at += 1
        return v

    def symbol(self, codes: dict) -> int:
        v = n = 0
        while n < 17:
            v, n = v << 1 | self.take(1), n + 1
            if (n, v) in codes:
                return codes[n, v]
        raise ValueError("no such code")


def _extend(v: int, size: int) -> int:
    return v if size == 0 or v >> (size - 1) else v - (1 << size) + 1


def _scan_slow(parts, order_of, which, first, last, high, low, tables, raw) -> None:
    """One scan of any progressive file, bit by bit, accumulated into the coefficient arrays."""
    bits, run = _Bits(raw), 0
    dc = [0, 0, 0]
    if first == 0:
        for unit in range(len(order_of[0])):
            for k in which:
                for b in order_of[k][unit] if len(which) > 1 else [unit]:
                    if high:
                        parts[k][b, 0] |= bits.take(1) << low
                    else:
                        size = bits.symbol(tables[0, which.index(k), k])
                        dc[k] += _extend(bits.take(size), size)
                        parts[k][b, 0] = dc[k] << low
        return
    k = which[0]
    codes = tables[1, 0, k]
    for block in parts[k]:
        at = first
        if run:
            run -= 1
            if high:
                for i in range(first, last + 1):
                    if block[i] and bits.take(1):
                        block[i] += (1 << low) if block[i] > 0 else -(1 << low)
            continue
        while at <= last:
            s = bits.symbol(codes)
            zeros, size = s >> 4, s & 15
            value = 0
            if size == 0 and zeros < 15:
                run = (1 << zeros) + bits.take(zeros) - 1
                if high:
                    for i in range(at, last + 1):
                        if block[i] and bits.take(1):
                            block[i] += (1 << low) if block[i] > 0 else -(1 << low)
                break
            if size:
                value = (1 if bits.take(1) else -1) << low if high else _extend(bits.take(size), size) * (1 << low)
            if not high:
                at += zeros
                if size:
                    block[at] = value
                at += 1
                continue
            while at <= last:
                if block[at]:
                    if bits.take(1):
                        block[at] += (1 << low) if block[at] > 0 else -(1 << low)
                elif zeros == 0:
                    if size:
                        block[at] = value
                    at += 1
                    break
                else:
                    zeros -= 1
                at += 1


def _scan_fast(parts, order, which, first, last, high, low, tables, raw) -> bool:
    """The same for a dense scan with fixed widths; False if the scan is not of that kind."""
    if first == 0:
        units = len(order)
        if high:
            inter = _bits_from_bytes(raw, units * 6).reshape(-1, 6) << low
            parts[0][order, 0] |= inter[:, :4].astype(np.int16)
            parts[1][:, 0] |= inter[:, 4].astype(np.int16)
            parts[2][:, 0] |= inter[:, 5].astype(np.int16)
            return True
        if any(t != DC_TABLE for t in tables):
            return False
        d = _DC_VALUES[_from_bytes(raw, DC_WIDTH, units * 6)].reshape(-1, 6).astype(np.int32)
        parts[0][order.ravel(), 0] = np.cumsum(d[:, :4].ravel()) << low
        parts[1][:, 0], parts[2][:, 0] = np.cumsum(d[:, 4]) << low, np.cumsum(d[:, 5]) << low
        return True
    block, n = parts[which[0]], last - first + 1
    if not high and tables[0] == AC_TABLE:
        block[:, first : last + 1] = _AC_VALUES[_from_bytes(raw, AC_WIDTH, len(block) * n)].reshape(-1, n) << low
        return True
    if high and tables[0] == EOB_TABLE and (band := block[:, first : last + 1]).all():
        bits = _bits_from_bytes(raw, len(block) * (n + 1)).reshape(-1, n + 1)[:, 1:].astype(np.int16) << low
        band += np.where(band > 0, bits, -bits)
        return True
    return False


def decode_coefficients(media: bytes, fast: bool = True) -> tuple[list[np.ndarray], list[np.ndarray], int, int, bytes]:
    """Coefficient arrays of the three components (zigzag order), their quantizers, columns, rows, and the comment."""
    at, quant, tables, comment = 2, {}, {}, b""
    parts: list = []
    while True:
        marker, size = media[at + 1], struct.unpack_from(">H", media, at + 2)[0]
        body = media[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == DQT:
            quant[body[0] & 15] = np.frombuffer(body[1:65], np.uint8)
        elif marker == COM:
            comment = body
        elif marker == DHT:
            while body:
                lengths = list(body[1:17])
                n = sum(lengths)
                tables[body[0] >> 4, body[0] & 15] = (lengths, body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == SOF2:
            _, height, width, n = struct.unpack_from(">BHHB", body)
            components = [(body[6 + 3 * k], body[7 + 3 * k], body[8 + 3 * k]) for k in range(n)]
            if [(i, s >> 4, s & 15) for i, s, _ in components] != list(PARTS):
                raise ValueError("4:2:0 is what this reader knows")
            across, down = ceil(width / 16), ceil(height / 16)
            parts = [np.zeros((across * down * h * v, 64), np.int16) for _, h, v in PARTS]
            order = _mcu_order(across, down)
            order_of = [order, np.arange(across * down)[:, None], np.arange(across * down)[:, None]]
            wanted = [q for _, _, q in components]
        elif marker == SOS:
            n = body[0]
            which = tuple([i for i, _, _ in PARTS].index(body[1 + 2 * k]) for k in range(n))
            picks = [body[2 + 2 * k] for k in range(n)]
            first, last, approx = body[1 + 2 * n : 4 + 2 * n]
            high, low = approx >> 4, approx & 15
            end = at
            while True:
                end = media.index(b"\xff", end)
                if media[end + 1]:
                    break
                end += 2
            raw, at = media[at:end], end
            kind = 1 if first else 0
            own = [tables[kind, p >> 4 if not first else p & 15] for p in picks] if not (kind == 0 and high) else []
            if not (fast and (first or len(which) == 3) and _scan_fast(parts, order, which, first, last, high, low, own, raw)):
                coded = {(kind, i, k): _codes(t) for i, (k, t) in enumerate(zip(which, own))}
                _scan_slow(parts, order_of, which, first, last, high, low, coded, raw)
        elif marker == EOI:
            break
        else:
            raise ValueError(f"marker {marker:02X}")
        if media[at + 1] == EOI:
            break
    return parts, [quant[q] for q in wanted], across, down, comment


def payload_of(parts: list[np.ndarray], comment: bytes) -> bytes:
    """The payload back from the coefficients."""
    n = struct.unpack(">Q", comment)[0]
    return (np.concatenate([p.ravel() for p in parts])[:n] - SHIFT).astype(np.uint8).tobytes()


def planes(parts: list[np.ndarray], quant: list[np.ndarray], across: int, down: int) -> list[np.ndarray]:
    """Sample planes of the components, before upsampling."""
    out = []
    for c, q, (_, h, v) in zip(parts, quant, PARTS):
        samples = (c * q.astype(np.float32)) @ _INVERSE
        out.append(samples.reshape(down * v, across * h, 8, 8).swapaxes(1, 2).reshape(down * v * 8, across * h * 8) + 128)
    return out


def to_rgb(parts: list[np.ndarray], quant: list[np.ndarray], across: int, down: int) -> np.ndarray:
    """The full-resolution tensor, rows x columns x 3 of 8 bits."""
    y, cb, cr = planes(parts, quant, across, down)
    cb, cr = ((np.repeat(np.repeat(p, 2, 0), 2, 1) - 128) for p in (cb, cr))
    out = np.empty((*y.shape, 3), np.uint8)
    for k, plane in enumerate((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb)):
        out[..., k] = np.clip(np.rint(plane), 0, 255)
    return out


def feature(rgb: np.ndarray) -> str:
    """Size and the sum of each colour of a tensor."""
    sums = rgb.reshape(-1, 3).sum(0, dtype=np.int64)
    return f"{rgb.shape[1]}x{rgb.shape[0]};" + ",".join(map(str, sums.tolist()))


def encoded(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media, the JPEG of each padded text."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(parts):
        for b in parts:
            for at in range(0, b.num_rows, 64):
                some = b.slice(at, 64)
                rows: dict[str, list] = {f.name: [] for f in schema}
                for doc, raw in zip(some.column(0).to_pylist(), raw_values(some.column(1))):
                    n = len(raw or b"")
                    media = encode((raw or b"") + bytes([FILL]) * (max(CHUNK, -(-n // CHUNK) * CHUNK) - n))
                    for name, v in zip(rows, (doc, n, media)):
                        rows[name].append(v)
                yield batches(rows, schema)

    return id_and_bytes(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def decoded(stored: DataFrame, tensors: bool = True) -> DataFrame:
    """Stored media with payload, feature, and the RGB tensor with its shape, all from the bytes as read."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("payload", pa.binary()), ("feature", pa.string()),
                        ("height", pa.int32()), ("width", pa.int32()), ("rgb", pa.binary())])

    def run(parts):
        for b in parts:
            for at in range(0, b.num_rows, 64):  # a few tensors at a time
                some = b.slice(at, 64)
                rows: dict[str, list] = {f.name: [] for f in schema}
                for doc, n, media in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), raw_values(some.column(2))):
                    c, q, across, down, comment = decode_coefficients(media)
                    rgb = to_rgb(c, q, across, down)
                    values = (doc, n, media, payload_of(c, comment), feature(rgb), rgb.shape[0], rgb.shape[1], rgb.tobytes() if tensors else None)
                    for name, v in zip(rows, values):
                        rows[name].append(v)
                yield batches(rows, schema)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(
        run, "doc_id long, n_bytes long, media binary, payload binary, feature string, height int, width int, rgb binary"
    )


def media_columns(docs: DataFrame, tensors: bool = True) -> DataFrame:
    """doc_id, n_bytes, media (the JPEG as stored), payload as read back from it, feature, and the RGB tensor with its shape."""
    return decoded(stage(encoded(docs), "media"), tensors)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a progressive JPEG, read back: digests and features."""
    from pyspark.sql import functions as F

    return media_columns(table(spark, sf_dir, "documents"), tensors=False).select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
