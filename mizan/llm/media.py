"""Media columns as baseline JPEG.

``encode`` stores a payload losslessly in a greyscale baseline JPEG: one 8x8 block for 64 payload bytes, each byte one
quantised coefficient in zigzag order, one restart interval for each block. The coefficient of byte b is b - 129 up to
128 and b - 128 above, so none is zero and blocks need no run or end-of-block codes; only the blocks that fill up the
last row of the picture are empty. ``decode`` reads any baseline JPEG: it parses the markers, Huffman-decodes the scans
(all restart intervals of all pictures of a batch side by side in numpy), and ``thumbnail`` rebuilds the luminance
from the DC terms alone.

Null text counts as the empty text; its payload is 64 zero bytes. A picture that can't be read gives nulls.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits

#: Payload bytes that are coded or decoded together.
CHUNK = 1 << 19
#: Blocks of a strip of a long picture; a picture is at most 65,535 pixels wide.
STRIP = 8000
_EMPTY_AC = 0x00
#: Code lengths by size category, for coefficients of text bytes: category 5 holds most small letters.
_CODE_LENGTHS = {5: 1, 4: 3, 6: 3, 7: 3, 3: 5, 8: 5, 2: 6, 1: 6, _EMPTY_AC: 6}
_Q_DC = 8
#: A marker other than a restart: neither FF 00, a stuffed byte, nor FF D0 to FF D7.
_SCAN_END = re.compile(rb"\xff[^\x00\xd0-\xd7]")
_ZIGZAG = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))
#: Quantisation table in zigzag order; a DC step of 8 makes a block's mean the coefficient plus 128.
_QUANT = bytes([_Q_DC] + [1] * 63)


def _canonical(counts: bytes, symbols: bytes) -> dict[int, tuple[int, int]]:
    """symbol: (code, length) of a DHT table."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            out[s] = (code, length)
            code += 1
        at, code = at + n, code << 1
    return out


_SYMBOLS = bytes(sorted(_CODE_LENGTHS, key=lambda s: (_CODE_LENGTHS[s], s)))
_COUNTS = bytes(sum(v == n for v in _CODE_LENGTHS.values()) for n in range(1, 17))
_CODES = _canonical(_COUNTS, _SYMBOLS)


def _byte_codes() -> tuple[np.ndarray, np.ndarray]:
    """For each payload byte the bits of its coefficient (code, then amplitude) and their number."""
    bits, size = np.zeros(256, np.uint64), np.zeros(256, np.uint64)
    for b in range(256):
        v = b - 129 if b <= 128 else b - 128
        cat = abs(v).bit_length()
        code, n = _CODES[cat]
        bits[b], size[b] = code << cat | (v if v > 0 else v + (1 << cat) - 1), n + cat
    return bits, size


_BITS, _SIZE = _byte_codes()
_BLANK = (_CODES[0][0] << _CODES[_EMPTY_AC][1] | _CODES[_EMPTY_AC][0], _CODES[0][1] + _CODES[_EMPTY_AC][1])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(width: int, height: int, payload: int, length: int) -> bytes:
    return b"".join((
        b"\xff\xd8",
        _segment(0xE9, b"PAYLOAD\0" + struct.pack(">QQ", payload, length)),
        _segment(0xDB, b"\0" + _QUANT),
        _segment(0xC0, struct.pack(">BHHB", 8, height, width, 1) + b"\x01\x11\x00"),
        _segment(0xC4, b"\x00" + _COUNTS + _SYMBOLS + b"\x10" + _COUNTS + _SYMBOLS),
        _segment(0xDD, struct.pack(">H", 1)),
        _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
    ))


def pad(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return data + b"\0" * (-len(data) % 64 or (0 if data else 64))


def _intervals(data: np.ndarray, full: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(coded bytes of a restart interval for each place of full, each with its marker; where each ends). data: a row of 64
    payload bytes for each place that is full; number: of the place in its picture."""
    data = data.reshape(-1, 16, 4)
    v, size = _BITS[data], _SIZE[data]
    word, length = v[..., 0], size[..., 0]
    for j in range(1, 4):  # four symbols of at most 14 bits fit a word
        word, length = word << size[..., j] | v[..., j], length + size[..., j]
    n_lanes = len(full)
    words, sizes = np.zeros((n_lanes, 17), np.uint64), np.zeros((n_lanes, 17), np.uint64)
    words[full, :16], sizes[full, :16] = word, length
    words[~full, 0], sizes[~full, 0] = _BLANK
    total = sizes.sum(axis=1)
    fill = (np.uint64(8) - (total & np.uint64(7))) & np.uint64(7)
    words[:, 16], sizes[:, 16] = (np.uint64(1) << fill) - np.uint64(1), fill
    start = np.cumsum(sizes, axis=1) - sizes
    out, rows = np.zeros((n_lanes, 64 * 14 // 64 + 2), np.uint64), np.arange(n_lanes)
    one, wide = np.uint64(1), np.uint64(64)
    for g in range(17):
        n, p = sizes[:, g], start[:, g]
        x = np.where(n > 0, words[:, g] << (wide - np.maximum(n, one)), np.uint64(0))
        at, off = (p >> np.uint64(6)).astype(np.intp), p & np.uint64(63)
        out[rows, at] |= x >> off
        out[rows, at + 1] |= (x << one) << (np.uint64(63) - off)
    n_bytes = ((total + fill) >> np.uint64(3)).astype(np.int64)
    flat = out.byteswap().view(np.uint8).reshape(n_lanes, -1)
    flat = flat[np.arange(flat.shape[1]) < n_bytes[:, None]]
    stuffed = flat == 255
    lane = np.repeat(rows, n_bytes)
    before = np.cumsum(stuffed) - stuffed
    ends = np.cumsum(n_bytes + np.bincount(lane, stuffed, n_lanes).astype(np.int64) + 2)
    coded = np.zeros(int(ends[-1]), np.uint8)
    coded[np.arange(len(flat)) + before + 2 * lane] = flat
    coded[ends - 2], coded[ends - 1] = 255, 0xD0 + number % 8
    return coded, ends


def _shape(payload: int) -> tuple[int, int, int]:
    """(full blocks, blocks across, blocks down) for so many payload bytes."""
    n = payload // 64
    w = math.isqrt(n - 1) + 1
    return n, w, -(-n // w)


def encode(texts: list[bytes]) -> list[bytes]:
    """A JPEG for each byte string. All are coded together; it takes a multiple of their size."""
    payloads = [pad(t) for t in texts]
    shapes = [_shape(len(p)) for p in payloads]
    lanes = np.array([w * h for _, w, h in shapes])
    full = np.concatenate([np.arange(w * h) < n for n, w, h in shapes])
    last = np.cumsum(lanes) - 1
    number = np.arange(len(full)) - np.repeat(last - lanes + 1, lanes)
    coded, ends = _intervals(np.frombuffer(b"".join(payloads), np.uint8), full, number)
    coded[ends[last] - 1] = 0xD9
    coded, cuts, result = coded.tobytes(), [0, *ends[last].tolist()], []
    for i, (_, w, h) in enumerate(shapes):
        result.append(_head(8 * w, 8 * h, len(payloads[i]), len(texts[i])) + coded[cuts[i] : cuts[i + 1]])
    return result


def encode_long(text: bytes, step: int = CHUNK // 64) -> bytes:
    """The same JPEG as ``encode`` makes, a run of blocks after another."""
    payload = len(text) + (-len(text) % 64 or (0 if text else 64))
    n, w, h = _shape(payload)
    out = bytearray(_head(8 * w, 8 * h, payload, len(text)))
    for i in range(0, w * h, step):
        number = np.arange(i, min(i + step, w * h))
        data = text[64 * i : 64 * (i + step)]
        out += _intervals(np.frombuffer(data + b"\0" * (min(payload, 64 * (i + step)) - 64 * i - len(data)), np.uint8), number < n, number)[0].tobytes()
    out[-1] = 0xD9
    return bytes(out)


@dataclass
class Picture:
    """What the markers say, and after decoding the quantised coefficients of each component's blocks, zigzag order."""

    width: int = 0
    height: int = 0
    restart: int = 0
    payload: tuple[int, int] | None = None
    quant: dict[int, list[int]] = field(default_factory=dict)
    huffman: dict[int, bytes] = field(default_factory=dict)
    parts: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, across, down, quantisation table
    scans: list[tuple[list[tuple[int, bytes, bytes]], int, int]] = field(default_factory=list)  # components, from, to
    coefficients: dict[int, np.ndarray] = field(default_factory=dict)
    error: str = ""
    size_at: int = 0  # where height and width stand


def parse(data: bytes) -> Picture:
    """Markers of a baseline JPEG; ``error`` tells why it can't be read."""
    p, at = Picture(), 2
    try:
        if data[:2] != b"\xff\xd8":
            raise ValueError("no start of image")
        while data[at + 1] != 0xD9:
            if data[at] != 0xFF:
                raise ValueError("no marker")
            marker = data[at + 1]
            if marker == 0xFF:
                at += 1
                continue
            size = struct.unpack_from(">H", data, at + 2)[0]
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xDB:
                while body:
                    wide = 1 + (body[0] >> 4)
                    p.quant[body[0] & 15] = list(struct.unpack(f">64{'BH'[wide - 1]}", body[1 : 1 + 64 * wide]))
                    body = body[1 + 64 * wide :]
            elif marker == 0xC4:
                while body:
                    n = 17 + sum(body[1:17])
                    p.huffman[body[0]], body = body[1:n], body[n:]
            elif marker in (0xC0, 0xC1):
                bits, p.height, p.width, n = struct.unpack_from(">BHHB", body)
                p.size_at = at - len(body) + 1
                if bits != 8 or not p.height or not p.width:
                    raise ValueError("not 8-bit samples of known size")
                p.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            elif 0xC2 <= marker <= 0xCF and marker != 0xCC:
                raise ValueError("not baseline")
            elif marker == 0xDD:
                p.restart = struct.unpack(">H", body)[0]
            elif marker == 0xE9 and body[:8] == b"PAYLOAD\0":
                p.payload = struct.unpack(">QQ", body[8:24])
            elif marker == 0xDA:
                ids = [x[0] for x in p.parts]
                chosen = [(ids.index(body[1 + 2 * i]), p.huffman[body[2 + 2 * i] >> 4], p.huffman[16 | body[2 + 2 * i] & 15]) for i in range(body[0])]
                begin, at = at, _SCAN_END.search(data, at).start()
                p.scans.append((chosen, begin, at))
    except (ValueError, IndexError, KeyError, AttributeError, struct.error) as e:
        p.error = str(e) or type(e).__name__
    if not p.error and not p.scans:
        p.error = "no scan"
    return p


@cache
def _peek_table(dht: bytes) -> np.ndarray:
    """For each 16 bits ahead: length of the code << 8 | symbol; 0 if there is no such code."""
    out = np.zeros(1 << 16, np.int64)
    for s, (code, n) in _canonical(dht[:16], dht[16:]).items():
        out[code << 16 - n : code + 1 << 16 - n] = n << 8 | s
    return out


def decode(pictures: list[bytes]) -> list[Picture]:
    """Parse and Huffman-decode; all restart intervals of all pictures advance together, a symbol at a time."""
    parsed = [parse(x) for x in pictures]
    tables: dict[bytes, int] = {}
    lane_start, lane_block, lane_left, lane_plan, owner, chunks, plans, blocks, base = [], [], [], [], [], [], [], 0, 0
    places = []
    for i, p in enumerate(parsed):
        if p.error:
            continue
        across, down = max(x[1] for x in p.parts), max(x[2] for x in p.parts)
        for chosen, begin, end in p.scans:
            single = len(chosen) == 1
            plan, grids = [], []
            for c, dc, ac in chosen:
                _, h, v, _ = p.parts[c]
                w_blocks, h_blocks = -(-p.width * h // (8 * across)), -(-p.height * v // (8 * down))
                n = 1 if single else h * v
                plan += [(c, tables.setdefault(dc, len(tables)), tables.setdefault(ac, len(tables)))] * n
                grids.append((c, h, v, w_blocks, h_blocks))
            columns, lines = (grids[0][3], grids[0][4]) if single else (-(-p.width // (8 * across)), -(-p.height // (8 * down)))
            mcus = columns * lines
            raw = np.frombuffer(pictures[i], np.uint8, end - begin, begin)
            ff = np.flatnonzero(raw[:-1] == 255)
            after = raw[ff + 1]
            marks = ff[(after >= 0xD0) & (after <= 0xD7)]
            gone = np.concatenate((ff[after == 0] + 1, marks, marks + 1))
            keep = np.ones(len(raw), bool)
            keep[gone] = False
            kept_before = np.cumsum(keep)
            step = p.restart or mcus
            starts = np.concatenate(([0], kept_before[marks + 1] if len(marks) else np.zeros(0, np.int64)))
            n_lanes = -(-mcus // step)
            if len(starts) != n_lanes:
                p.error = "restart intervals missing"
                break
            lane_start.append((starts + base) * 8)
            first = np.arange(n_lanes) * step
            lane_block.append(blocks + first * len(plan))
            lane_left.append(np.minimum(step, mcus - first) * len(plan))
            lane_plan.append(np.full(n_lanes, len(plans)))
            owner.append(np.full(n_lanes, i))
            plans.append(plan)
            chunks.append(raw[keep])
            base += len(chunks[-1])
            places.append((i, single, grids, blocks, mcus * len(plan), columns, lines, len(plan)))
            blocks += mcus * len(plan)
    if not chunks:
        return parsed
    stream = np.concatenate((*chunks, np.full(16, 255, np.uint8)))
    window = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(stream, 8)).view(">u8").ravel().astype(np.uint64)
    peek = np.concatenate([_peek_table(t) for t in tables])
    widest = max(map(len, plans))
    unit = np.zeros((len(plans), widest, 3), np.int64)
    for j, plan in enumerate(plans):
        unit[j, : len(plan)] = plan
    units = np.array([len(x) for x in plans])
    pos, block, left, plan_of, own = (np.concatenate(x) for x in (lane_start, lane_block, lane_left, lane_plan, owner))
    coefficients = np.zeros((blocks, 64), np.int32)
    k, turn, pred = np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64), np.zeros((len(pos), 4), np.int64)
    bad = np.zeros(len(parsed), bool)
    u = np.uint64

    def step_of(lane: np.ndarray, dc: bool) -> None:
        at = pos[lane]
        ahead = window[np.minimum(at >> 3, len(window) - 1)] << (at & 7).astype(u)
        e = peek[unit[plan_of[lane], turn[lane], 1 if dc else 2] * 65536 + (ahead >> u(48)).astype(np.int64)]
        n, symbol = e >> 8, e & 255
        size = symbol if dc else symbol & 15
        amp = (((ahead << n.astype(u)) >> u(1)) >> (63 - size).astype(u)).astype(np.int64)
        value = np.where(amp < (1 << size) >> 1, amp - (1 << size) + 1, amp)
        broken = (n == 0) | (at >= 8 * (len(stream) - 8))
        if broken.any():
            bad[own[lane[broken]]] = True
        pos[lane] = at + n + size
        if dc:
            c = unit[plan_of[lane], turn[lane], 0]
            value = np.where(size > 0, value, 0) + pred[lane, c]
            pred[lane, c] = value
            coefficients[block[lane], 0] = value
            k[lane] = 1
        else:
            to = k[lane] + (symbol >> 4)
            some = size > 0
            where = np.minimum(to, 63)
            if some.all():
                coefficients[block[lane], where] = value
            else:
                coefficients[block[lane[some]], where[some]] = value[some]
            k[lane] = np.where(some | (symbol == 0xF0), to + 1, 64)
        if broken.any():
            k[lane[broken]], left[lane[broken]] = 64, 1

    active = np.arange(len(pos))
    while len(active):
        dc = k[active] == 0
        if dc.all():
            step_of(active, True)
        elif not dc.any():
            step_of(active, False)
        else:
            step_of(active[dc], True)
            step_of(active[~dc], False)
        over = k[active] >= 64
        if over.any():
            done = active[over]
            left[done] -= 1
            block[done] += left[done] > 0
            turn[done] = (turn[done] + 1) % units[plan_of[done]]
            k[done] = 0
            active = active[left[active] > 0]
    for i, single, grids, first, n, columns, lines, per in places:
        p = parsed[i]
        if bad[i]:
            p.error = "broken scan"
            continue
        own_blocks, at = coefficients[first : first + n].reshape(lines, columns, per, 64), 0
        for c, h, v, w_blocks, h_blocks in grids:
            if single:
                p.coefficients[c] = own_blocks[:, :, 0]
            else:
                x = own_blocks[:, :, at : at + h * v].reshape(lines, columns, v, h, 64).transpose(0, 2, 1, 3, 4)
                p.coefficients[c] = x.reshape(lines * v, columns * h, 64)[:h_blocks, :w_blocks]
                at += h * v
    return parsed


def strips(data: bytes, p: Picture, step: int = STRIP) -> Iterator[Picture]:
    """A picture of one component with an interval for each block, as runs of blocks, each decoded as a picture of one row."""
    begin, end = p.scans[0][1:]
    raw = np.frombuffer(data, np.uint8, end - begin, begin)
    cuts = [begin]
    for i in range(0, len(raw), CHUNK):
        part = raw[i : i + CHUNK + 1]
        marks = np.flatnonzero((part[:-1] == 255) & (part[1:] >= 0xD0) & (part[1:] <= 0xD7)) + i + begin
        cuts += (marks + 2).tolist()
    cuts.append(end + 2)
    head = bytearray(data[:begin])
    for i in range(0, len(cuts) - 1, step):
        n = min(step, len(cuts) - 1 - i)
        struct.pack_into(">HH", head, p.size_at, 8, 8 * n)
        yield decode([bytes(head) + data[cuts[i] : cuts[i + n] - 2] + b"\xff\xd9"])[0]


def can_be_cut(p: Picture) -> bool:
    return not p.error and len(p.scans) == 1 == len(p.parts) and p.restart == 1 == p.parts[0][1] * p.parts[0][2]


def _bytes_of(coefficients: np.ndarray) -> bytes:
    return (coefficients + np.where(coefficients < 0, 129, 128)).astype(np.uint8).tobytes()


def payload_of(p: Picture) -> bytes:
    """The bytes that ``encode`` stored."""
    return _bytes_of(p.coefficients[0].reshape(-1)[: p.payload[0]])


def read_long(data: bytes) -> tuple[Picture, np.ndarray | None, list[bytes]]:
    """(picture without coefficients, thumbnail, payload in pieces) of a long picture, a run of blocks after another."""
    p = parse(data)
    if not can_be_cut(p):
        p = decode([data])[0]
        return p, None if p.error else thumbnail(p), [payload_of(p)] if p.payload and not p.error else []
    luma, pieces, left = [], [], p.payload[0] if p.payload else 0
    for strip in strips(data, p):
        if strip.error:
            p.error = strip.error
            return p, None, []
        luma.append(thumbnail(strip)[0])
        flat = strip.coefficients[0].reshape(-1)[:left]
        left -= len(flat)
        pieces.append(_bytes_of(flat))
    blocks, across, down = np.concatenate(luma), -(-p.width // 8), -(-p.height // 8)
    if len(blocks) != across * down:
        p.error = "restart intervals missing"
        return p, None, []
    return p, blocks.reshape(down, across), pieces


def thumbnail(p: Picture) -> np.ndarray:
    """Luminance by block from the DC terms: 8-bit, a pixel for each 8x8 block."""
    return np.clip(np.rint(p.coefficients[0][:, :, 0] * p.quant[p.parts[0][3]][0] / 8 + 128), 0, 255).astype(np.uint8)


def thumbnail_hash(t: np.ndarray) -> str:
    """64-bit mean hash of the thumbnail drawn to 8x8, then the head of its SHA-256; both as hex."""
    small = t[np.arange(8) * t.shape[0] // 8][:, np.arange(8) * t.shape[1] // 8]
    return np.packbits(small > t.mean()).tobytes().hex() + hashlib.sha256(t.tobytes()).hexdigest()[:16]


def _sized(values: list[bytes], most: int) -> Iterator[slice]:
    """Slices of about that many bytes; longer values stand alone."""
    begin = total = 0
    for i, x in enumerate(values):
        if total and total + len(x) > most:
            yield slice(begin, i)
            begin, total = i, 0
        total += len(x) + 64
    if begin < len(values):
        yield slice(begin, len(values))


def to_media(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, media binary): each text as UTF-8 in a JPEG. Null text: empty. Null ids, repeated rows: a row each."""
    arrow_limits(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x or b"" for x in b.column(1).cast(pa.binary()).to_pylist()]
            for s in _sized(texts, CHUNK):
                coded = [encode_long(texts[s.start])] if len(texts[s.start]) > CHUNK else encode(texts[s])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s.start, s.stop - s.start), pa.array(coded, pa.binary())], ["id", "media"])

    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, f"id {dict(src.dtypes)['id']}, media binary")


FEATURES = "media_bytes long, media_sha256 string, width int, height int, payload binary, text_bytes long, thumbnail binary, thumbnail_hash string, error string"


def media_features(df: DataFrame, id_col: str = "id", media_col: str = "media", keep_bytes: bool = True) -> DataFrame:
    """Dimensions, payload (where ``encode`` wrote one) and thumbnail of each JPEG.

    keep_bytes: with payload and thumbnail; else the payload gives payload_bytes, payload_sha256 and tail_crc32.
    Null or broken media: null features and the reason in ``error``.
    """
    arrow_limits(df.sparkSession)
    src = df.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    schema = f"id {dict(src.dtypes)['id']}, " + (FEATURES if keep_bytes else FEATURES.replace("payload binary", "payload_bytes long, payload_sha256 string, tail_crc32 long").replace("thumbnail binary, ", ""))

    def row(media: bytes, p: Picture, t: np.ndarray | None, pieces: list[bytes]) -> dict:
        out = {"media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "error": p.error or None}
        if p.error:
            return out
        out |= {"width": p.width, "height": p.height, "thumbnail_hash": thumbnail_hash(t)}
        if p.payload:
            out |= {"text_bytes": p.payload[1]}
            if keep_bytes:
                out |= {"payload": b"".join(pieces)}
            else:
                sha = hashlib.sha256()
                for x in pieces:
                    sha.update(x)
                out |= {"payload_bytes": sum(map(len, pieces)), "payload_sha256": sha.hexdigest(), "tail_crc32": zlib.crc32(pieces[-1][-64:])}
        return out | ({"thumbnail": t.tobytes()} if keep_bytes else {})

    def rows(media: list[bytes]) -> list[dict]:
        if len(media[0]) > 2 * CHUNK:
            return [row(media[0], *read_long(media[0]))]
        return [row(m, p, None if p.error else thumbnail(p), [payload_of(p)] if p.payload and not p.error else []) for m, p in zip(media, decode(media), strict=True)]

    names = [x.split()[0] for x in schema.split(", ")][1:]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[x.split()[1]] for x in schema.split(", ")[1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            media = [x or b"" for x in b.column(1).to_pylist()]
            for s in _sized(media, CHUNK):
                found = rows(media[s])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s.start, s.stop - s.start), *(pa.array([r.get(n) for r in found], t) for n, t in zip(names, types, strict=True))], ["id", *names])

    return src.mapInArrow(run, schema)


def op1(documents: DataFrame) -> DataFrame:
    """The contract's digest of ``to_media`` and ``media_features``."""
    f = media_features(to_media(documents, "doc_id", "text"), keep_bytes=False)
    return f.select(
        F.col("id").alias("doc_id"), F.col("text_bytes").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
        F.concat_ws(":", F.concat_ws("x", "width", "height"), "thumbnail_hash").alias("feature"), "width", "height",
    )
