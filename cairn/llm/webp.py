"""Media columns: lossless WebP in numpy.

The decoder reads prefix codes, back-references and the colour cache, picks codes by the
entropy image, inverts the predictor, cross-colour, subtract-green and palette transforms and gives
pixel arrays. It decodes many images in lockstep: each is a lane with its own bit
position, and a step decodes the next pixel (or back-reference) of every lane that isn't
done, so a batch of small images costs array operations, not a Python loop per pixel.

The encoder writes any image with the transforms asked for, and, by a vectorised path, columns of
bytes: each byte is the green sample of a pixel, rows of ``WIDTH`` pixels, strips of ``STRIP``
rows, each with prefix codes of its own and runs as back-references; several strips are
the frames of one animated file. A strip of few different bytes gets a palette (two, four or eight bytes
to a pixel), one whose bytes go on from their left or upper neighbours a predictor, where that is estimated to be
smaller. Cross-colour, subtract-green and the colour cache gain nothing where only one channel
has content: the encoder of columns does without them. Encoding depends on the bytes alone.

Edge cases: null or empty text: one row of bytes 255; texts of any length (strips follow each other);
repeated rows get equal rows; an empty table gives no rows; a stream that isn't lossless WebP or that is
cut short raises ValueError; further columns are carried by ``store_texts`` and ``read_media``, those named like
an output are replaced.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import schema_of, small_batches

WIDTH, STRIP = 576, 16
#: Longest prefix code that the encoder makes (the format allows 15).
LONGEST = 11

# fixed values of the format: order of the code length code, and (x, y) of the short distances
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
HASH = np.uint32(0x1E35A7BD)
BLACK = np.uint32(0xFF000000)
PREDICTOR, CROSS, GREEN, PALETTE = 0, 1, 2, 3


class Bits:
    """A scalar reader for headers: least significant bit first."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at, self.size = data, at, len(data) * 8
        self._from, self._held = 0, 0
        self._load()

    def _load(self):
        self._from = self.at >> 3
        self._held = int.from_bytes(self.data[self._from : self._from + 64], "little")

    def __call__(self, n: int) -> int:
        if self.at + n > self.size:
            raise ValueError("the stream is cut short")
        shift = self.at - 8 * self._from
        if shift + n > 512:
            self._load()
            shift = self.at - 8 * self._from
        self.at += n
        return self._held >> shift & ((1 << n) - 1)


# --- prefix codes -------------------------------------------------------------

_REVERSED: dict[int, np.ndarray] = {}


def _reversed(n: int) -> np.ndarray:
    if n not in _REVERSED:
        x, out = np.arange(1 << n), np.zeros(1 << n, np.int64)
        for _ in range(n):
            out, x = out << 1 | x & 1, x >> 1
        _REVERSED[n] = out
    return _REVERSED[n]


def code_table(lengths: np.ndarray) -> np.ndarray:
    """symbol << 4 | length, by the next bits of the stream; one symbol alone takes no bits."""
    used = np.flatnonzero(lengths)
    if len(used) == 0:
        raise ValueError("a prefix code without symbols")
    if len(used) == 1:
        return np.array([used[0] << 4], np.int32)
    used = used[np.argsort(lengths[used], kind="stable")]
    size = lengths[used].astype(np.int64)
    most = int(size[-1])
    wide = 1 << (most - size)
    if wide.sum() != 1 << most:
        raise ValueError("a prefix code that is not complete")
    return np.repeat((used << 4 | size).astype(np.int32), wide)[_reversed(most)]


def read_code(bits: Bits, alphabet: int) -> np.ndarray:
    lengths = np.zeros(alphabet, np.int64)
    if bits(1):
        two = bits(1)
        first = bits(8 if bits(1) else 1)
        own = [first, bits(8)] if two else [first]
        if max(own) >= alphabet:
            raise ValueError("a symbol beyond the alphabet")
        lengths[own] = 1
        return code_table(lengths)
    own = np.zeros(19, np.int64)
    for k in LENGTH_ORDER[: 4 + bits(4)]:
        own[k] = bits(3)
    table = code_table(own).tolist()
    mask = len(table) - 1
    most = 2 + bits(2 + 2 * bits(3)) if bits(1) else alphabet
    out: list[int] = []
    before = 8
    while len(out) < alphabet and most:
        most -= 1
        shift = bits.at - 8 * bits._from
        if shift > 480:
            bits._load()
            shift = bits.at - 8 * bits._from
        e = table[bits._held >> shift & mask]
        bits.at += e & 15
        s = e >> 4
        if s < 16:
            out.append(s)
            before = s or before
        elif s == 16:
            out += [before] * (3 + bits(2))
        elif s == 17:
            out += [0] * (3 + bits(3))
        else:
            out += [0] * (11 + bits(7))
    if len(out) > alphabet or bits.at > bits.size:
        raise ValueError("code lengths beyond the alphabet or the stream")
    lengths[: len(out)] = out
    return code_table(lengths)


# --- streams ------------------------------------------------------------------


class Stream:
    """The header of an entropy-coded image: everything before its pixels."""

    def __init__(self, bits: Bits, width: int, height: int, main: bool):
        self.width, self.height, self.meta, self.meta_bits = width, height, None, 0
        self.cache_bits = bits(4) if bits(1) else 0
        if self.cache_bits > 11:
            raise ValueError("a colour cache that is too large")
        groups = 1
        if main and bits(1):
            self.meta_bits = bits(3) + 2
            sub = _sub_image(bits, _blocks(width, self.meta_bits), _blocks(height, self.meta_bits))
            self.meta = (sub >> np.uint32(8) & np.uint32(0xFFFF)).astype(np.int64)
            groups = int(self.meta.max()) + 1
        green = 256 + 24 + (1 << self.cache_bits if self.cache_bits else 0)
        self.groups = [[read_code(bits, n) for n in (green, 256, 256, 256, 40)] for _ in range(groups)]
        self.data, self.at = bits.data, bits.at


def _blocks(n: int, bits: int) -> int:
    return (n + (1 << bits) - 1) >> bits


def _sub_image(bits: Bits, width: int, height: int) -> np.ndarray:
    stream = Stream(bits, width, height, False)
    pixels, ends = decode_lanes([stream])
    bits.at = ends[0]
    bits._load()
    return pixels[0]


def _value(symbol: int, read) -> int:
    """A length or distance from its prefix symbol and extra bits."""
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + read(extra) + 1


def decode_lanes(streams: list[Stream]) -> tuple[list[np.ndarray], list[int]]:
    """The pixels (height x width, ARGB) of streams, all decoded in lockstep, and where each stream's bits end."""
    lanes = len(streams)
    sizes = np.array([s.width * s.height for s in streams], np.int64)
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint32)
    room = np.array([len(s.data) + 16 for s in streams], np.int64)
    first = np.cumsum(room) - room
    joined = np.frombuffer(b"".join(s.data + b"\0" * 16 for s in streams), np.uint8)
    window = np.ndarray((len(joined) - 4,), "<u4", joined.tobytes(), 0, (1,))
    group_of = np.cumsum([0] + [len(s.groups) for s in streams])
    flat = [t for s in streams for g in s.groups for t in g]
    length = np.array([len(t) for t in flat], np.int64)
    base = (np.cumsum(length) - length).reshape(-1, 5)
    mask = (length - 1).reshape(-1, 5)
    table = np.concatenate(flat)
    alone = (mask[:, 1:4] == 0).all()
    fixed = table[base[:, 1:4]] >> 4
    fixed = (fixed[:, 0] << 16 | fixed[:, 1] | fixed[:, 2] << 24).astype(np.uint32)
    caches = np.array([s.cache_bits for s in streams], np.int64)
    cache_at = np.cumsum(np.where(caches > 0, 1 << caches, 0)) - np.where(caches > 0, 1 << caches, 0)
    cache = np.zeros(int((1 << caches[caches > 0]).sum()), np.uint32)
    metas = [s.meta is not None for s in streams]
    any_meta, any_cache = any(metas), bool(caches.any())
    ends = np.zeros(lanes, np.int64)

    lane = np.arange(lanes)
    pos = first * 8 + np.array([s.at for s in streams])
    o, end = starts.copy(), starts + sizes
    limit = (first + room - 16) * 8
    g = group_of[:-1].copy()
    gb, gm, fx = base[g, 0], mask[g, 0], fixed[g]

    def put(lanes_, colours):
        on = caches[lanes_] > 0
        if on.any():
            lanes_, colours = lanes_[on], colours[on]
            cache[cache_at[lanes_] + ((colours * HASH) >> (32 - caches[lanes_]).astype(np.uint32)).astype(np.int64)] = colours

    while len(lane):
        if any_meta:
            for j, k in enumerate(lane.tolist()):
                if metas[k]:
                    s, at = streams[k], int(o[j] - starts[k])
                    g[j] = group_of[k] + s.meta[(at // s.width) >> s.meta_bits, (at % s.width) >> s.meta_bits]
            gb, gm, fx = base[g, 0], mask[g, 0], fixed[g]
        e = table[gb + (window[pos >> 3] >> (pos & 7).astype(np.uint32) & gm)]
        pos += e & 15
        symbol = e >> 4
        literal = symbol < 256
        whole = literal.all()
        if alone:
            colour = fx | symbol.astype(np.uint32) << np.uint32(8)
        else:
            colour = symbol.astype(np.uint32) << np.uint32(8)
            for k, shift in ((1, 16), (2, 0), (3, 24)):
                e = table[base[g, k] + (window[pos >> 3] >> (pos & 7).astype(np.uint32) & mask[g, k])]
                pos += np.where(literal, e & 15, 0)
                colour |= (e >> 4).astype(np.uint32) << np.uint32(shift)
        if whole:
            out[o] = colour
            if any_cache:
                put(lane, colour)
            o += 1
        else:
            cached = symbol >= 280
            if cached.any():
                colour[cached] = cache[cache_at[lane[cached]] + symbol[cached] - 280]
            one = literal | cached
            out[o[one]] = colour[one]
            if any_cache:
                put(lane[one], colour[one])
            for j in np.flatnonzero(~one).tolist():
                k = int(lane[j])
                bits = Bits(streams[k].data, int(pos[j] - first[k] * 8))
                n = _value(int(symbol[j]) - 256, bits)
                own = streams[k].groups[g[j] - group_of[k]][4]
                e = int(own[_peek(bits, len(own) - 1)])
                bits.at += e & 15
                d = _value(e >> 4, bits)
                if d > 120:
                    d -= 120
                else:
                    x, y = NEAR[d - 1]
                    d = max(1, x + y * streams[k].width)
                at = int(o[j])
                if at - d < starts[k] or at + n > end[j]:
                    raise ValueError("a back-reference beyond the image")
                out[at : at + n] = np.resize(out[at - d : at], n) if d < n else out[at - d : at - d + n]
                if caches[k]:
                    put(np.full(n, k), out[at : at + n])
                o[j] += n - 1
                pos[j] = bits.at + first[k] * 8
            o += 1
        done = o >= end
        if done.any():
            ends[lane[done]] = pos[done] - first[lane[done]] * 8
            if (pos > limit).any():
                raise ValueError("the stream is cut short")
            go = ~done
            lane, pos, o, end, limit, g, gb, gm, fx = (x[go] for x in (lane, pos, o, end, limit, g, gb, gm, fx))
        elif (pos > limit).any():
            raise ValueError("the stream is cut short")
    return [out[a : a + n].reshape(s.height, s.width) for a, n, s in zip(starts, sizes, streams, strict=True)], ends.tolist()


def _peek(bits: Bits, mask: int) -> int:
    at = bits.at >> 3
    return int.from_bytes(bits.data[at : at + 4], "little") >> (bits.at & 7) & mask


# --- transforms ---------------------------------------------------------------


def channels(argb: np.ndarray) -> np.ndarray:
    """height x width x (blue, green, red, alpha), bytes."""
    return np.ascontiguousarray(argb).astype("<u4").view(np.uint8).reshape(*argb.shape, 4)


def packed(c: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(c).view("<u4")[..., 0].astype(np.uint32)


def predict(mode: int, left, top, top_right, top_left) -> np.ndarray:
    """A predicted pixel (channels as int) from its neighbours, which may be arrays of pixels."""
    half = lambda a, b: (a + b) >> 1
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return top_right
    if mode == 4:
        return top_left
    if mode == 5:
        return half(half(left, top_right), top)
    if mode == 6:
        return half(left, top_left)
    if mode == 7:
        return half(left, top)
    if mode == 8:
        return half(top_left, top)
    if mode == 9:
        return half(top, top_right)
    if mode == 10:
        return half(half(left, top_left), half(top, top_right))
    if mode == 11:
        to_left = np.abs(top - top_left).sum(-1, keepdims=True)
        to_top = np.abs(left - top_left).sum(-1, keepdims=True)
        return np.where(to_left < to_top, left, top)
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    if mode == 13:
        mean = half(left, top)
        d = mean - top_left
        return np.clip(mean + np.where(d < 0, -(-d >> 1), d >> 1), 0, 255)
    return np.broadcast_to(np.array([0, 0, 0, 255]), np.shape(top))


def _modes(sub: np.ndarray, bits: int, width: int, height: int) -> np.ndarray:
    """The mode of each pixel: borders have their own."""
    m = (sub >> np.uint32(8) & np.uint32(15)).astype(np.int64)
    full = m[np.arange(height)[:, None] >> bits, np.arange(width) >> bits]
    full[0], full[:, 0] = 1, 2
    full[0, 0] = 0
    return full


def undo_predictor(argb: np.ndarray, sub: np.ndarray, bits: int) -> np.ndarray:
    height, width = argb.shape
    c = channels(argb).astype(np.int64)
    modes = _modes(sub, bits, width, height)
    for y in range(height):
        row = modes[y]
        cuts = [0, *(np.flatnonzero(row[1:] != row[:-1]) + 1).tolist(), width]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            mode = int(row[a])
            if mode in (0, 2, 3, 4, 8, 9, 14, 15):  # no left neighbour: the run at once
                c[y, a:b] = (c[y, a:b] + predict(mode, None, *_above(c, y, a, b))) & 255
            elif mode == 1:
                c[y, a:b] = (np.cumsum(c[y, a:b], 0) + (c[y, a - 1] if a else 0)) & 255
            else:
                for x in range(a, b):
                    top, right, corner = _above(c, y, x, x + 1)
                    c[y, x] = (c[y, x] + predict(mode, c[y, x - 1], top[0], right[0], corner[0])) & 255
    return packed(c.astype(np.uint8))


def _above(c, y, a, b):
    """top, top right (beyond the last column: the first pixel of this row) and top left of the pixels a to b of row y."""
    width = c.shape[1]
    if y == 0:
        none = np.zeros((b - a, 4), np.int64)
        return none, none, none
    right = c[y - 1, a + 1 : b + 1] if b < width else np.concatenate((c[y - 1, a + 1 :], c[y, :1]))
    corner = c[y - 1, a - 1 : b - 1] if a else np.concatenate((c[y - 1, :1], c[y - 1, : b - 1]))
    return c[y - 1, a:b], right, corner


def do_predictor(argb: np.ndarray, sub: np.ndarray, bits: int) -> np.ndarray:
    height, width = argb.shape
    c = channels(argb).astype(np.int64)
    modes = _modes(sub, bits, width, height)
    out = c.copy()
    for y in range(height):
        left = np.concatenate((np.zeros((1, 4), np.int64), c[y, :-1]))
        for mode in set(modes[y].tolist()):
            at = modes[y] == mode
            out[y, at] = (c[y] - predict(mode, left, *_above(c, y, 0, width)))[at] & 255
    return packed(out.astype(np.uint8))


def cross_colour(argb: np.ndarray, sub: np.ndarray, bits: int, undo: bool) -> np.ndarray:
    height, width = argb.shape
    e = channels(sub).view(np.int8).astype(np.int64)[np.arange(height)[:, None] >> bits, np.arange(width) >> bits]
    c = channels(argb).astype(np.int64)
    signed = lambda x: (x & 255 ^ 128) - 128
    delta = lambda t, x: t * signed(x) >> 5
    blue, green, red = c[..., 0], c[..., 1], c[..., 2]
    to_red = delta(e[..., 0], green)
    new_red = (red + (to_red if undo else -to_red)) & 255
    to_blue = delta(e[..., 1], green) + delta(e[..., 2], new_red if undo else red)
    c[..., 0], c[..., 2] = (blue + (to_blue if undo else -to_blue)) & 255, new_red
    return packed(c.astype(np.uint8))


def green_transform(argb: np.ndarray, undo: bool) -> np.ndarray:
    c = channels(argb).copy()
    g = c[..., 1] if undo else np.uint8(0) - c[..., 1]
    c[..., 0] += g
    c[..., 2] += g
    return packed(c)


def palette_bits(n: int) -> int:
    return 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0


def undo_palette(argb: np.ndarray, colours: np.ndarray, width: int) -> np.ndarray:
    k = palette_bits(len(colours))
    x = np.arange(width)
    per = 8 >> k
    index = (argb[:, x >> k] >> np.uint32(8) & np.uint32(255)) >> ((x & ((1 << k) - 1)) * per).astype(np.uint32) & np.uint32((1 << per) - 1)
    full = np.zeros(256, np.uint32)  # beyond the table: transparent black
    full[: len(colours)] = colours
    return full[index]


def do_palette(argb: np.ndarray, colours: np.ndarray) -> np.ndarray:
    k = palette_bits(len(colours))
    order = np.argsort(colours)
    index = order[np.searchsorted(colours, argb, sorter=order)].astype(np.uint32)
    height, width = argb.shape
    out = np.zeros((height, _blocks(width, k)), np.uint32)
    for x in range(width):
        out[:, x >> k] |= index[:, x] << np.uint32((x & ((1 << k) - 1)) * (8 >> k))
    return BLACK | out << np.uint32(8)


# --- decoding files -----------------------------------------------------------


def _open(data: bytes) -> tuple[Stream, list, int]:
    """Of a VP8L chunk: the main stream, the transforms to undo, and the image's width."""
    bits = Bits(data)
    if bits(8) != 0x2F:
        raise ValueError("not a lossless image")
    width, height = bits(14) + 1, bits(14) + 1
    bits(1)
    if bits(3):
        raise ValueError("an unknown version")
    now, transforms = width, []
    while bits(1):
        kind = bits(2)
        if any(t[0] == kind for t in transforms):
            raise ValueError("a transform that comes twice")
        if kind in (PREDICTOR, CROSS):
            size = bits(3) + 2
            transforms.append((kind, _sub_image(bits, _blocks(now, size), _blocks(height, size)), size))
        elif kind == PALETTE:
            n = bits(8) + 1
            steps = channels(_sub_image(bits, n, 1))
            transforms.append((kind, packed(np.cumsum(steps, 1, dtype=np.uint8))[0], now))
            now = _blocks(now, palette_bits(n))
        else:
            transforms.append((kind, None, 0))
    return Stream(bits, now, height, True), transforms, width


def decode_images(chunks: list[bytes]) -> list[np.ndarray]:
    """ARGB pixels of VP8L chunks, decoded together."""
    opened = [_open(x) for x in chunks]
    pixels, _ = decode_lanes([x[0] for x in opened]) if opened else ([], [])
    out = []
    for argb, (_, transforms, _) in zip(pixels, opened, strict=True):
        for kind, sub, size in reversed(transforms):
            if kind == PREDICTOR:
                argb = undo_predictor(argb, sub, size)
            elif kind == CROSS:
                argb = cross_colour(argb, sub, size, True)
            elif kind == GREEN:
                argb = green_transform(argb, True)
            else:
                argb = undo_palette(argb, sub, size)
        out.append(argb)
    return out


def frames(data: bytes) -> tuple[tuple[int, int] | None, list[tuple[int, int, bytes]]]:
    """Canvas size (None: that of the one image) and (x, y, VP8L chunk) of a file's frames."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP" or int.from_bytes(data[4:8], "little") + 8 > len(data):
        raise ValueError("not a whole WebP file")
    canvas, found = None, []

    def walk(at, end, x, y):
        nonlocal canvas
        while at + 8 <= end:
            kind, n = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
            body = at + 8
            if body + n > end:
                raise ValueError("a chunk that is cut short")
            three = lambda k: int.from_bytes(data[body + k : body + k + 3], "little")  # noqa: B023, E731
            if kind == b"VP8X":
                canvas = three(4) + 1, three(7) + 1
            elif kind == b"ANMF":
                walk(body + 16, body + n, three(0) * 2, three(3) * 2)
            elif kind == b"VP8L":
                found.append((x, y, data[body : body + n]))
            elif kind == b"VP8 ":
                raise ValueError("a lossy image")
            at = body + n + (n & 1)

    walk(12, int.from_bytes(data[4:8], "little") + 8, 0, 0)
    if not found:
        raise ValueError("a file without an image")
    return canvas, found


def decode_files(files: list[bytes]) -> list[np.ndarray]:
    """ARGB pixels of files; the frames of an animated file are laid onto its canvas in order."""
    parts = [frames(x) for x in files]
    pixels = iter(decode_images([c for _, found in parts for _, _, c in found]))
    out = []
    for canvas, found in parts:
        own = [(x, y, next(pixels)) for x, y, _ in found]
        if canvas is None:
            out.append(own[0][2])
            continue
        full = np.zeros((canvas[1], canvas[0]), np.uint32)
        for x, y, argb in own:
            full[y : y + argb.shape[0], x : x + argb.shape[1]] = argb
        out.append(full)
    return out


# --- encoding -----------------------------------------------------------------


class Writer:
    """Collects bits, least significant first, in one integer."""

    def __init__(self):
        self.value, self.at = 0, 0

    def __call__(self, value: int, n: int) -> None:
        self.value |= value << self.at
        self.at += n

    def bytes(self) -> bytes:
        return self.value.to_bytes((self.at + 7) // 8, "little")


def code_lengths(counts: np.ndarray, longest: int) -> np.ndarray:
    """Lengths of a complete prefix code of at most ``longest`` bits for the symbols that occur."""
    out = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        out[used] = 1
        return out
    weight = counts[used]
    while True:
        order = np.argsort(weight, kind="stable")
        leaves = weight[order].tolist()
        n, i, j = len(leaves), 0, 0
        inner: list[int] = []
        parent = [0] * (2 * n - 1)
        for k in range(n, 2 * n - 1):
            total = 0
            for _ in range(2):
                if i < n and (j >= len(inner) or leaves[i] <= inner[j]):
                    total += leaves[i]
                    parent[i] = k
                    i += 1
                else:
                    total += inner[j]
                    parent[n + j] = k
                    j += 1
            inner.append(total)
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth[:n]) <= longest:
            out[used[order]] = depth[:n]
            return out
        weight = weight // 2 + 1  # flatter counts


def code_values(lengths: np.ndarray) -> np.ndarray:
    """The bits of each symbol's code, as they go into the stream."""
    used = np.flatnonzero(lengths)
    out = np.zeros(len(lengths), np.int64)
    if len(used) < 2:
        return out
    used = used[np.argsort(lengths[used], kind="stable")]
    size = lengths[used]
    most = int(size[-1])
    wide = 1 << (most - size)
    begin = np.cumsum(wide) - wide
    out[used] = _reversed(most)[begin] & ((1 << size) - 1)
    return out


def write_code(w: Writer, counts: np.ndarray, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """Write a prefix code for the counts; lengths and values of its symbols (one symbol alone: length 0)."""
    used = np.flatnonzero(counts)
    n = len(counts)
    if len(used) == 0:
        used = np.zeros(1, np.int64)
    if len(used) == 1 and used[0] < 256:
        w(0b01 if used[0] < 2 else 0b101, 3)
        w(int(used[0]), 1 if used[0] < 2 else 8)
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    if len(used) == 1:  # too large a symbol for the short form: give it company
        counts = counts.copy()
        counts[0] = 1
    lengths = code_lengths(counts, longest)
    values = code_values(lengths)
    steps: list[tuple[int, int, int]] = []  # symbol, extra bits, their number
    edges = np.flatnonzero(np.diff(lengths)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), n], strict=True):
        run, own = b - a, int(lengths[a])
        while run:
            if own == 0 and run >= 3:
                k = min(run, 138)
                steps.append((18, k - 11, 7) if k > 10 else (17, k - 3, 3))
            else:
                k = 1
                steps.append((own, 0, 0))
            run -= k
    tally = np.bincount([s for s, _, _ in steps], minlength=19)
    if np.count_nonzero(tally) == 1:
        tally[0 if tally[0] == 0 else 1] = 1
    own = code_lengths(tally, 7)
    codes = code_values(own)
    ordered = [int(own[k]) for k in LENGTH_ORDER]
    while len(ordered) > 4 and ordered[-1] == 0:
        ordered.pop()
    w(0, 1)
    w(len(ordered) - 4, 4)
    for x in ordered:
        w(x, 3)
    w(0, 1)
    own, codes = own.tolist(), codes.tolist()
    value, at = 0, 0
    for s, extra, k in steps:
        value |= (codes[s] | extra << own[s]) << at
        at += own[s] + k
    w(value, at)
    return lengths, values


def prefix_of(value: int) -> tuple[int, int, int]:
    """Symbol, extra bits and their number of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    h = v.bit_length() - 1
    return 2 * h + (v >> (h - 1) & 1), v & ((1 << (h - 1)) - 1), h - 1


def _entropy_image(w: Writer, argb: np.ndarray, *, main: bool = False, cache_bits: int = 0, matches: bool = True, meta: np.ndarray | None = None, meta_bits: int = 2) -> None:
    """Write pixels with back-references, a colour cache and one group of codes, or those of the meta image."""
    height, width = argb.shape
    w(1, 1) if cache_bits else w(0, 1)
    if cache_bits:
        w(cache_bits, 4)
    if main:
        w(int(meta is not None), 1)
        if meta is not None:
            w(meta_bits - 2, 3)
            _entropy_image(w, BLACK | meta.astype(np.uint32) << np.uint32(8))
    px = argb.ravel().tolist()
    groups = int(meta.max()) + 1 if meta is not None else 1
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    counts = [[np.zeros(n, np.int64) for n in sizes] for _ in range(groups)]
    cache: dict[int, int] = {}
    seen: dict[tuple, int] = {}
    steps: list[tuple[int, list[tuple[int, int, int, int]]]] = []  # group, (code, symbol, extra, bits)
    i = 0
    short = {}
    for k, (x, y) in reversed(list(enumerate(NEAR))):
        short[max(1, x + y * width)] = k + 1
    while i < len(px):
        own = int(meta[(i // width) >> meta_bits, (i % width) >> meta_bits]) if meta is not None else 0
        n = 0
        at = seen.get(tuple(px[i : i + 3]), -1) if matches else -1
        if at >= 0:
            while i + n < len(px) and n < 4096 and px[at + n] == px[i + n]:
                n += 1
        if n >= 3:
            d = i - at
            s, extra, k = prefix_of(n)
            t, more, m = prefix_of(short.get(d, d + 120))
            todo = [(0, 256 + s, extra, k), (4, t, more, m)]
        else:
            n, p = 1, px[i]
            slot = (p * int(HASH) & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
            if cache_bits and cache.get(slot) == p:
                todo = [(0, 280 + slot, 0, 0)]
            else:
                todo = [(0, p >> 8 & 255, 0, 0), (1, p >> 16 & 255, 0, 0), (2, p & 255, 0, 0), (3, p >> 24, 0, 0)]
        for code, symbol, _, _ in todo:
            counts[own][code][symbol] += 1
        steps.append((own, todo))
        for j in range(i, i + n):
            seen[tuple(px[j : j + 3])] = j
            if cache_bits:
                cache[(px[j] * int(HASH) & 0xFFFFFFFF) >> (32 - cache_bits)] = px[j]
        i += n
    codes = [[write_code(w, c) for c in group] for group in counts]
    for own, todo in steps:
        for code, symbol, extra, k in todo:
            lengths, values = codes[own][code]
            w(int(values[symbol]), int(lengths[symbol]))
            w(extra, k)


def encode_image(argb: np.ndarray, *, palette: bool = False, green: bool = False, predictor: np.ndarray | None = None, cross: np.ndarray | None = None, bits: int = 2, **options) -> bytes:
    """A VP8L chunk. predictor: a mode for each block of 2^bits pixels; cross: colour elements (ARGB) of blocks."""
    height, width = argb.shape
    w = Writer()
    w(0x2F, 8)
    w(width - 1, 14)
    w(height - 1, 14)
    w(1, 1)
    w(0, 3)
    if palette:
        colours = np.unique(argb)
        w(1 | PALETTE << 1, 3)
        w(len(colours) - 1, 8)
        c = channels(colours[None, :])
        _entropy_image(w, packed(np.diff(c, axis=1, prepend=np.zeros((1, 1, 4), np.uint8))))
        argb = do_palette(argb, colours)
    if predictor is not None:
        sub = BLACK | predictor.astype(np.uint32) << np.uint32(8)
        w(1 | PREDICTOR << 1, 3)
        w(bits - 2, 3)
        _entropy_image(w, sub)
        argb = do_predictor(argb, sub, bits)
    if cross is not None:
        w(1 | CROSS << 1, 3)
        w(bits - 2, 3)
        _entropy_image(w, cross)
        argb = cross_colour(argb, cross, bits, False)
    if green:
        w(1 | GREEN << 1, 3)
        argb = green_transform(argb, False)
    w(0, 1)
    _entropy_image(w, argb, main=True, **options)
    return w.bytes()


def _chunk(kind: bytes, body: bytes) -> bytes:
    return kind + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) & 1)


def to_file(chunks: list[tuple[int, int, bytes]], width: int, height: int) -> bytes:
    """A WebP file of one image, or an animated one of frames (y, rows, VP8L chunk) of full width."""
    if len(chunks) == 1:
        body = _chunk(b"VP8L", chunks[0][2])
    else:
        three = lambda x: x.to_bytes(3, "little")
        parts = [_chunk(b"VP8X", b"\x02\0\0\0" + three(width - 1) + three(height - 1)), _chunk(b"ANIM", b"\0" * 6)]
        parts += [_chunk(b"ANMF", three(0) + three(y // 2) + three(width - 1) + three(rows - 1) + three(0) + b"\x02" + _chunk(b"VP8L", c)) for y, rows, c in chunks]
        body = b"".join(parts)
    return b"RIFF" + (len(body) + 4).to_bytes(4, "little") + b"WEBP" + body


def _estimate(samples: np.ndarray) -> float:
    """About how many bytes prefix codes for these samples take."""
    n = np.bincount(samples.ravel(), minlength=256)
    n = n[n > 0]
    bits = (n * np.log2(n.sum() / n)).sum()
    return float((max(bits, n.sum()) if len(n) > 1 else 0) / 8 + 0.6 * len(n))  # a code has one bit at least


#: Bytes that a palette or predictor costs besides its pixels, about.
COST = 24
ACROSS, DOWN = 1, 2


def _transformed(samples: np.ndarray, w: Writer) -> tuple[np.ndarray, int]:
    """Write the transform that makes a strip smallest, if one does; the samples left to code, and the alpha of all pixels."""
    x = samples.reshape(-1, WIDTH)
    best, least = None, _estimate(x)
    if np.count_nonzero(np.bincount(samples, minlength=256)) <= 16:
        argb = BLACK | x.astype(np.uint32) << np.uint32(8)
        colours = np.unique(argb)
        indices = (do_palette(argb, colours) >> np.uint32(8)).astype(np.uint8)
        if _estimate(indices) + COST + len(colours) < least:
            best, least = (colours, indices), _estimate(indices) + COST + len(colours)
    across, down = np.diff(x, axis=1, prepend=x[:, :1]), np.diff(x, axis=0, prepend=x[:1])
    across[:, 0], down[0] = down[:, 0], across[0]  # borders have their own mode
    across[0, 0] = down[0, 0] = x[0, 0]
    for mode, rest in ((ACROSS, across), (DOWN, down)):
        if _estimate(rest) + COST < least:
            best, least = (mode, rest), _estimate(rest) + COST
    if best is None:
        w(0, 1)
        return samples, 255
    kind, rest = best
    if isinstance(kind, int):
        w(1 | PREDICTOR << 1, 3)
        w(9 - 2, 3)  # blocks of 512 pixels
        _entropy_image(w, np.full((_blocks(len(x), 9), _blocks(WIDTH, 9)), BLACK | np.uint32(kind << 8)))
        alpha = 0
    else:
        w(1 | PALETTE << 1, 3)
        w(len(kind) - 1, 8)
        _entropy_image(w, packed(np.diff(channels(kind[None, :]), axis=1, prepend=np.zeros((1, 1, 4), np.uint8))))
        alpha = 255
    w(0, 1)
    return rest.ravel(), alpha


def _strip(samples: np.ndarray) -> tuple[Writer, np.ndarray, np.ndarray]:
    """The header of a strip with its transform, and the bits of its pixels (values, numbers): literals, and runs as back-references to the pixel before."""
    w = Writer()
    w(0x2F | (WIDTH - 1) << 8 | (len(samples) // WIDTH - 1) << 22 | 1 << 36, 40)
    samples, alpha = _transformed(samples, w)
    n = len(samples)
    w(0, 2)  # no colour cache, one group of codes
    edge = np.flatnonzero(samples[1:] != samples[:-1]) + 1
    begin = np.append(0, edge)
    run = np.diff(np.append(begin, n))
    long = np.flatnonzero(run >= 6)
    keep = np.ones(n, bool)
    at: list[int] = []
    lengths: list[tuple[int, int, int]] = []
    for a, k in zip(begin[long].tolist(), run[long].tolist(), strict=True):
        a, k = a + 1, k - 1
        keep[a : a + k] = False
        while k:
            part = min(k, 4096)
            keep[a] = True
            at.append(a)
            lengths.append(prefix_of(part))
            a, k = a + part, k - part
    symbol = samples.astype(np.int64)
    if at:
        symbol[at] = [256 + s for s, _, _ in lengths]
    symbol = symbol[keep]
    green, values = write_code(w, np.bincount(symbol, minlength=280))
    w(0b0001, 4)  # red 0
    w(0b0001, 4)  # blue 0
    w(0b0001, 4) if alpha == 0 else w(0b101 | alpha << 3, 11)
    w(0b0001 | 1 << 3, 4)  # distance symbol 1: value 2, the pixel to the left
    bits, size = values[symbol], green[symbol]
    if at:
        place = (np.cumsum(keep) - 1)[at]
        bits[place] |= np.array([e for _, e, _ in lengths]) << size[place]
        size[place] += [k for _, _, k in lengths]
    return w, bits, size


def encode_bytes(payloads: list[bytes]) -> list[bytes]:
    """A WebP file for each payload, whose length is a positive multiple of WIDTH."""
    made: list[tuple[int, int, int, Writer]] = []
    values, sizes, counts = [], [], []
    for i, p in enumerate(payloads):
        samples = np.frombuffer(p, np.uint8)
        for a in range(0, len(p), WIDTH * STRIP):
            part = samples[a : a + WIDTH * STRIP]
            w, v, s = _strip(part)
            made.append((i, a // WIDTH, len(part) // WIDTH, w))
            values.append(v)
            sizes.append(s)
            counts.append(len(v))
    if not made:
        return []
    value, size = np.concatenate(values).astype(np.uint64), np.concatenate(sizes)
    strip = np.repeat(np.arange(len(made)), counts)
    first = np.cumsum(counts) - counts
    total = np.cumsum(size) - size
    head = np.array([w.at for _, _, _, w in made], np.int64)
    bits = np.add.reduceat(size, first)
    room = (head + bits + 63) // 32 + 1
    word0 = np.cumsum(room) - room
    place = total - total[first][strip] + head[strip] + word0[strip] * 32
    word, shift = place >> 5, (place & 31).astype(np.uint64)
    start = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    summed = np.add.reduceat(value << shift, start)  # bits of different symbols never meet
    out = np.zeros(int(room.sum()) + 1, np.uint64)
    out[word[start]] += summed & np.uint64(0xFFFFFFFF)
    out[word[start] + 1] += summed >> np.uint64(32)
    raw = out.astype("<u4").tobytes()
    files: list[list[tuple[int, int, bytes]]] = [[] for _ in payloads]
    for (i, y, rows, w), at, n in zip(made, word0.tolist(), (head + bits).tolist(), strict=True):
        body = bytearray(raw[at * 4 : at * 4 + (n + 7) // 8])
        own = w.bytes()
        last = body[len(own) - 1]
        body[: len(own)] = own
        body[len(own) - 1] |= last
        files[i].append((y, rows, bytes(body)))
    return [to_file(f, WIDTH, f[-1][0] + f[-1][1]) for f in files]


def decode_bytes(files: list[bytes]) -> list[bytes]:
    """The payloads: green samples in reading order."""
    return [(x >> np.uint32(8) & np.uint32(255)).astype(np.uint8).tobytes() for x in decode_files(files)]


def pad(raw: bytes) -> bytes:
    return raw + b"\xff" * (max(1, -(-len(raw) // WIDTH)) * WIDTH - len(raw))


def feature(samples: np.ndarray) -> str:
    """Rows, distinct samples, their sum, and changes between neighbours of the decoded pixels."""
    return f"rows={len(samples) // WIDTH};distinct={np.count_nonzero(np.bincount(samples, minlength=256))};sum={int(samples.sum(dtype=np.int64))};changes={int(np.count_nonzero(samples[1:] != samples[:-1]))}"


def store_texts(df: DataFrame, *, text_col: str = "text") -> DataFrame:
    """df without the text, with n_bytes and media: the text as a lossless WebP file."""
    small_batches(df.sparkSession, 3)  # more lanes for a step
    keep = [c for c in df.columns if c not in (text_col, "n_bytes", "media")]

    def run(batches):
        for batch in batches:
            raw = [(x or "").encode() for x in batch.column(len(keep)).to_pylist()]
            distinct = list(dict.fromkeys(raw))
            made = dict(zip(distinct, encode_bytes([pad(x) for x in distinct]), strict=True))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array([len(x) for x in raw], pa.int64()), pa.array([made[x] for x in raw], pa.binary())], names=[*keep, "n_bytes", "media"])

    schema = ", ".join([*([schema_of(df, keep)] if keep else []), "n_bytes long, media binary"])
    return df.select(*keep, F.col(text_col).alias("_text")).mapInArrow(run, schema)


def read_media(df: DataFrame, *, media_col: str = "media", digests: bool = False) -> DataFrame:
    """df without the media, with payload (the bytes read back), or with its size, digests and features and those of the media."""
    small_batches(df.sparkSession, 3)  # more lanes for a step
    made = {"payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string"} if digests else {"payload": "binary"}
    keep = [c for c in df.columns if c not in made and c != media_col]

    def run(batches):
        for batch in batches:
            media = batch.column(len(keep)).to_pylist()
            distinct = [x for x in dict.fromkeys(media) if x is not None]
            found = dict(zip(distinct, decode_bytes(distinct), strict=True))
            rows = []
            for m in media:
                p = found.get(m)
                if p is None:
                    rows.append((None,) * len(made))
                elif digests:
                    rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature(np.frombuffer(p, np.uint8))))
                else:
                    rows.append((p,))
            types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
            cols = list(zip(*rows, strict=True)) or [()] * len(made)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(c, types[t]) for c, t in zip(cols, made.values(), strict=True))], names=[*keep, *made])

    schema = ", ".join([*([schema_of(df, keep)] if keep else []), *(f"{k} {v}" for k, v in made.items())])
    return df.select(*keep, F.col(media_col).alias("_media")).mapInArrow(run, schema)


def op6_lossless_webp(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return read_media(store_texts(docs), digests=True)
