"""Lossless WebP, written from its public specification: a decoder of whole
streams, an encoder for all their parts, and batch forms of both.

`decode` reads one image step by step.  `decode_batch` reads many at once:
each image is a lane, a step reads one pixel of every lane with array
operations, and lanes leave when their image ends.

Pixels are uint8 arrays [height, width, 4] in the order green, red, blue,
alpha, in which a stream codes them.
"""

from __future__ import annotations

import struct

import numpy as np

# Fixed values of the format.
SIGNATURE = 0x2F
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
LITERALS, LENGTHS, DISTANCES = 256, 24, 40
CACHE_FACTOR = 0x1E35A7BD
LARGEST = 1 << 14
#: Near distances: cells at most 8 to the right, 7 to the left and 7 up, by squared distance, upper first, right before left.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda c: (c[0] ** 2 + c[1] ** 2, -c[1], -c[0]))


class Reader:
    """Bits of a byte string, lowest first."""

    def __init__(self, data: bytes):
        self.value, self.at, self.size = int.from_bytes(data, "little"), 0, 8 * len(data)
        self.low, self.held = 0, -1

    def bits(self, n: int) -> int:
        # a window of the number keeps shifts short
        if self.held < 0 or self.at + n > self.held + 4096:
            if self.at + n > self.size:
                raise ValueError("the stream ends early")
            self.held = self.at
            self.low = (self.value >> self.at) & ((1 << 4096) - 1)
        out = (self.low >> (self.at - self.held)) & ((1 << n) - 1)
        self.at += n
        return out


class Writer:
    def __init__(self):
        self.value = self.size = 0

    def bits(self, value: int, n: int) -> None:
        self.value |= value << self.size
        self.size += n

    def done(self) -> bytes:
        return self.value.to_bytes(-(-self.size // 8), "little")


# ---- prefix codes


def code_lengths(counts: list[int], most: int = 15) -> list[int]:
    """Lengths of a complete prefix code, none over `most`; 0 where the count is 0."""
    used = [(n, s) for s, n in enumerate(counts) if n]
    lengths = [0] * len(counts)
    if len(used) < 2:
        for _, s in used:
            lengths[s] = 1
        return lengths
    used.sort()
    while True:
        # leaves in ascending order, then inner nodes, whose weights ascend as they are made
        weights = [n for n, _ in used]
        n, leaf, inner = len(used), 0, len(used)
        parent = [0] * (2 * n - 1)
        for node in range(n, 2 * n - 1):
            total = 0
            for _ in range(2):
                if leaf < n and (inner >= node or weights[leaf] <= weights[inner]):
                    total += weights[leaf]
                    parent[leaf] = node
                    leaf += 1
                else:
                    total += weights[inner]
                    parent[inner] = node
                    inner += 1
            weights.append(total)
        depth = [0] * (2 * n - 1)
        for node in range(2 * n - 3, -1, -1):
            depth[node] = depth[parent[node]] + 1
        if max(depth[:n]) <= most:
            for (_, s), d in zip(used, depth):
                lengths[s] = d
            return lengths
        used = [(n // 2 + 1, s) for n, s in used]


#: Every 15-bit number with its bits in reverse.
_BACKWARDS = (np.packbits(np.unpackbits(np.arange(1 << 15, dtype=">u2").view(np.uint8)).reshape(-1, 16)[:, :0:-1], axis=1).view(">u2").ravel().astype(np.int64) >> 1).tolist()


def canonical(lengths) -> list[int]:
    """The code of each symbol, bits reversed as a stream holds them."""
    code, codes, last = 0, [0] * len(lengths), 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - last
        last = n
        codes[s] = _BACKWARDS[code] >> (15 - n)
        code += 1
    return codes


def lookup(lengths) -> tuple[np.ndarray, int]:
    """(table, bits): table[next bits] = symbol * 16 + length; one symbol alone takes no bits."""
    used = [(n, s) for s, n in enumerate(lengths) if n]
    if not used:
        return np.zeros(1, np.uint16), 0
    if len(used) == 1:
        return np.array([used[0][1] << 4], np.uint16), 0
    width = max(used)[0]
    if sum(1 << (width - n) for n, _ in used) != 1 << width:
        raise ValueError("the prefix code isn't complete")
    table, codes = np.zeros(1 << width, np.uint16), canonical(lengths)
    for n, s in used:
        table[codes[s] :: 1 << n] = s << 4 | n
    return table, width


def write_code(out: Writer, lengths: list[int]) -> None:
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and all(s < LITERALS for s in used):
        used = used or [0]
        out.bits(1, 1)
        out.bits(len(used) - 1, 1)
        wide = used[0] > 1
        out.bits(int(wide), 1)
        out.bits(used[0], 8 if wide else 1)
        if len(used) == 2:
            out.bits(used[1], 8)
        return
    tokens: list[tuple[int, int, int]] = []  # symbol, extra, bits of extra
    end, i = used[-1] + 1, 0
    while i < end:
        n, run = lengths[i], 1
        while i + run < end and lengths[i + run] == n:
            run += 1
        i += run
        if n:
            tokens.append((n, 0, 0))
            run -= 1
            while run >= 3:
                take = min(run, 6)
                tokens.append((16, take - 3, 2))
                run -= take
        else:
            while run >= 3:
                take = min(run, 138)
                tokens.append((18, take - 11, 7) if take > 10 else (17, take - 3, 3))
                run -= take
        tokens += [(n, 0, 0)] * run
    counts = [0] * 19
    for s, _, _ in tokens:
        counts[s] += 1
    if sum(map(bool, counts)) == 1:  # a code of two symbols at least
        counts[1 if counts[0] else 0] += 1
    inner = code_lengths(counts, 7)
    codes = canonical(inner)
    n = max(k + 1 for k, s in enumerate(LENGTH_ORDER) if inner[s])
    n = max(4, n)
    out.bits(0, 1)
    out.bits(n - 4, 4)
    for s in LENGTH_ORDER[:n]:
        out.bits(inner[s], 3)
    out.bits(1, 1)  # the number of tokens follows
    width = max(2, (len(tokens) - 2).bit_length() + ((len(tokens) - 2).bit_length() & 1))
    out.bits((width - 2) // 2, 3)
    out.bits(len(tokens) - 2, width)
    for s, extra, k in tokens:
        out.bits(codes[s] | extra << inner[s], inner[s] + k)


def read_code(data: Reader, size: int) -> list[int]:
    lengths = [0] * size
    if data.bits(1):
        n = data.bits(1) + 1
        lengths[data.bits(8 if data.bits(1) else 1)] = 1
        if n == 2:
            lengths[data.bits(8)] = 1
        return lengths
    inner = [0] * 19
    for s in LENGTH_ORDER[: 4 + data.bits(4)]:
        inner[s] = data.bits(3)
    left = 2 + data.bits(2 + 2 * data.bits(3)) if data.bits(1) else size
    table, width = lookup(inner)
    table, i, last = table.tolist(), 0, 8
    while i < size and left:
        left -= 1
        entry = table[data.bits(width)]
        data.at -= width - (entry & 15)
        s = entry >> 4
        if s < 16:
            lengths[i] = s
            last = s or last
            i += 1
        else:
            n, value = (3 + data.bits(2), last) if s == 16 else (3 + data.bits(3), 0) if s == 17 else (11 + data.bits(7), 0)
            if i + n > size:
                raise ValueError("code lengths beyond the alphabet")
            lengths[i : i + n] = [value] * n
            i += n
    return lengths


def _prefix(value: int) -> tuple[int, int, int]:
    """(symbol, extra, bits of extra) of a length or distance from 1."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    top = v.bit_length() - 1
    second = v >> (top - 1) & 1
    return 2 * top + second, v & ((1 << (top - 1)) - 1), top - 1


def _unprefix(symbol: int, data: Reader) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + data.bits(extra) + 1


def distance_of(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


# ---- entropy-coded images; a pixel is an int, alpha << 24 | red << 16 | green << 8 | blue


def _read_image(data: Reader, width: int, height: int, main: bool) -> list[int]:
    cache_bits = data.bits(4) if data.bits(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    groups, tiles, tile_bits, across = 1, None, 0, 0
    if main and data.bits(1):
        tile_bits = data.bits(3) + 2
        across = (width + (1 << tile_bits) - 1) >> tile_bits
        tiles = [p >> 8 & 0xFFFF for p in _read_image(data, across, (height + (1 << tile_bits) - 1) >> tile_bits, False)]
        groups = max(tiles) + 1
    alphabet = LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0)
    codes = []
    for _ in range(groups):
        group = [lookup(read_code(data, n)) for n in (alphabet, 256, 256, 256, DISTANCES)]
        codes.append([(t.tolist(), w) for t, w in group])
    cache = [0] * (1 << cache_bits)

    def symbol(code) -> int:
        table, n = code
        short = min(n, data.size - data.at)
        entry = table[data.bits(short)]
        data.at -= short - (entry & 15)
        return entry >> 4

    out: list[int] = []
    total = width * height
    while len(out) < total:
        at = len(out)
        group = codes[tiles[(at // width >> tile_bits) * across + (at % width >> tile_bits)]] if tiles else codes[0]
        s = symbol(group[0])
        if s < LITERALS:
            red, blue, alpha = symbol(group[1]), symbol(group[2]), symbol(group[3])
            new = [alpha << 24 | red << 16 | s << 8 | blue]
        elif s < LITERALS + LENGTHS:
            n = _unprefix(s - LITERALS, data)
            back = distance_of(_unprefix(symbol(group[4]), data), width)
            if back > at or at + n > total:
                raise ValueError("a reference leaves the image")
            for k in range(n):
                out.append(out[at + k - back])
            new = []
        else:
            new = [cache[s - LITERALS - LENGTHS]]
        out += new
        if cache_bits:
            for p in out[at:]:
                cache[(CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
    return out


def _average(a: int, b: int) -> int:
    return (a & b) + (((a ^ b) & 0xFEFEFEFE) >> 1)


def _add(a: int, b: int) -> int:
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00) | ((a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF)


def _channels(p: int) -> tuple[int, int, int, int]:
    return p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255


def _clamped(values) -> int:
    out = 0
    for v in values:
        out = out << 8 | (0 if v < 0 else 255 if v > 255 else v)
    return out


def predicted(mode: int, left: int, top: int, right: int, corner: int) -> int:
    """The prediction of a mode; right is the pixel above to the right, corner above to the left."""
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return _average(_average(left, right), top)
    if mode == 6:
        return _average(left, corner)
    if mode == 7:
        return _average(left, top)
    if mode == 8:
        return _average(corner, top)
    if mode == 9:
        return _average(top, right)
    if mode == 10:
        return _average(_average(left, corner), _average(top, right))
    if mode == 11:
        cost = sum(abs(t - c) - abs(l - c) for l, t, c in zip(_channels(left), _channels(top), _channels(corner)))
        return left if cost < 0 else top
    if mode == 12:
        return _clamped(l + t - c for l, t, c in zip(_channels(left), _channels(top), _channels(corner)))
    if mode == 13:
        halves = [(a, a - c) for a, c in zip(_channels(_average(left, top)), _channels(corner))]
        return _clamped(a + (d // 2 if d >= 0 else -(-d // 2)) for a, d in halves)
    return 0xFF000000


def _mode_at(pixels: list[int], at: int, width: int, mode: int) -> int:
    x, y = at % width, at // width
    if not at:
        return 0xFF000000
    if not y:
        return pixels[at - 1]
    if not x:
        return pixels[at - width]
    return predicted(mode, pixels[at - 1], pixels[at - width], pixels[at - width + 1], pixels[at - width - 1])


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint8).view(np.int8).astype(np.int32)


def _cross(pixels: list[int], width: int, bits: int, elements: list[int], sign: int) -> list[int]:
    """Adds (sign 1) or takes away (sign -1) the colour transform."""
    p = np.array(pixels, np.uint32)
    at = np.arange(len(p))
    across = (width + (1 << bits) - 1) >> bits
    e = np.array(elements, np.uint32)[(at // width >> bits) * across + (at % width >> bits)]
    green, red, blue = _signed(p >> 8 & 255), (p >> 16 & 255).astype(np.int32), (p & 255).astype(np.int32)
    to_red, to_blue, red_to_blue = _signed(e & 255), _signed(e >> 8 & 255), _signed(e >> 16 & 255)
    new = red + sign * (to_red * green >> 5) & 255
    base = new if sign > 0 else red
    blue = blue + sign * ((to_blue * green >> 5) + (red_to_blue * _signed(base) >> 5)) & 255
    return ((p & np.uint32(0xFF00FF00)) | new.astype(np.uint32) << np.uint32(16) | blue.astype(np.uint32)).tolist()


def _green(pixels: list[int], sign: int) -> list[int]:
    p = np.array(pixels, np.int64)
    g = p >> 8 & 255
    return ((p & 0xFF00FF00) | ((p >> 16 & 255) + sign * g & 255) << 16 | ((p & 255) + sign * g & 255)).tolist()


def _packing(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def chunk(data: bytes) -> bytes:
    """The VP8L bytes of a file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"VP8L":
            return data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no lossless image")


def _inverted(pixels: list[int], undo: list[tuple], height: int) -> list[int]:
    """Pixels with the transforms (kind, width, bits or colours, their own image) taken back, the last one first."""
    for kind, wide, size, part in reversed(undo):
        if kind == PREDICTOR:
            blocks = (wide + (1 << size) - 1) >> size
            for at in range(len(pixels)):
                mode = part[(at // wide >> size) * blocks + (at % wide >> size)] >> 8 & 15
                pixels[at] = _add(pixels[at], _mode_at(pixels, at, wide, mode))
        elif kind == CROSS_COLOUR:
            pixels = _cross(pixels, wide, size, part, 1)
        elif kind == SUBTRACT_GREEN:
            pixels = _green(pixels, 1)
        else:
            pack = _packing(size)
            each, narrow = 8 >> pack, (wide + (1 << pack) - 1) >> pack
            full = []
            for y in range(height):
                for x in range(wide):
                    i = (pixels[y * narrow + (x >> pack)] >> 8 & 255) >> (each * (x & ((1 << pack) - 1))) & ((1 << each) - 1)
                    full.append(part[i] if i < size else 0)
            pixels = full
    return pixels


def _samples(pixels, width: int, height: int) -> np.ndarray:
    p = np.asarray(pixels, np.uint32)
    return np.stack([p >> 8, p >> 16, p, p >> 24], axis=1).astype(np.uint8).reshape(height, width, 4)


def _transforms(bits: Reader, width: int, height: int) -> tuple[list[tuple], int]:
    """(transforms as _inverted takes them, width of the coded image)."""
    undo, across = [], width
    while bits.bits(1):
        kind = bits.bits(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            size = bits.bits(3) + 2
            part = _read_image(bits, (across + (1 << size) - 1) >> size, (height + (1 << size) - 1) >> size, False)
            undo.append((kind, across, size, part))
        elif kind == SUBTRACT_GREEN:
            undo.append((kind, across, 0, []))
        else:
            colours = bits.bits(8) + 1
            palette = _read_image(bits, colours, 1, False)
            for i in range(1, colours):
                palette[i] = _add(palette[i], palette[i - 1])
            undo.append((kind, across, colours, palette))
            across = (across + (1 << _packing(colours)) - 1) >> _packing(colours)
    return undo, across


def decode(data: bytes) -> np.ndarray:
    """The pixels of any lossless file."""
    body = chunk(data)
    if body[:1] != bytes([SIGNATURE]):
        raise ValueError("not a lossless stream")
    bits = Reader(body[1:])
    width, height = bits.bits(14) + 1, bits.bits(14) + 1
    bits.bits(1)
    if bits.bits(3):
        raise ValueError("unknown version")
    undo, across = _transforms(bits, width, height)
    pixels = _read_image(bits, across, height, True)
    return _samples(_inverted(pixels, undo, height), width, height)


def _write_image(out: Writer, pixels: list[int], width: int, main: bool, cache_bits: int = 0, references: bool = False, tile_bits: int = 0) -> None:
    out.bits(int(cache_bits > 0), 1)
    if cache_bits:
        out.bits(cache_bits, 4)
    height = len(pixels) // width
    across = (width + (1 << tile_bits) - 1) >> tile_bits if tile_bits else 1
    group_of = (lambda at: ((at // width >> tile_bits) * across + (at % width >> tile_bits)) % 2) if tile_bits else (lambda at: 0)
    if main:
        out.bits(int(tile_bits > 0), 1)
        if tile_bits:
            out.bits(tile_bits - 2, 3)
            n = across * ((height + (1 << tile_bits) - 1) >> tile_bits)
            _write_image(out, [(i % 2) << 8 for i in range(n)], across, False)
    alphabet = LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0)
    tokens, cache, seen, at = [], [None] * (1 << cache_bits), {}, 0
    while at < len(pixels):
        start, n = at, 0
        if references and at + 2 < len(pixels):
            back = seen.get(tuple(pixels[at : at + 3]))
            if back is not None:
                while at + n < len(pixels) and n < 4096 and pixels[at + n] == pixels[back + n]:
                    n += 1
        slot = (CACHE_FACTOR * pixels[at] & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
        if n >= 3:
            near = next((k for k, c in enumerate(NEAR) if max(1, c[0] + c[1] * width) == at - back), None)
            tokens.append((group_of(at), (n, near + 1 if near is not None else at - back + len(NEAR)), None))
            at += n
        else:
            hit = cache_bits and cache[slot] == pixels[at]
            tokens.append((group_of(at), slot, None) if hit else (group_of(at), None, pixels[at]))
            at += 1
        for k in range(start, at):
            if references and k + 2 < len(pixels):
                seen[tuple(pixels[k : k + 3])] = k
            if cache_bits:
                cache[(CACHE_FACTOR * pixels[k] & 0xFFFFFFFF) >> (32 - cache_bits)] = pixels[k]
    groups = 2 if tile_bits and across * ((height + (1 << tile_bits) - 1) >> tile_bits) > 1 else 1
    counts = [[[0] * n for n in (alphabet, 256, 256, 256, DISTANCES)] for _ in range(groups)]
    for g, special, p in tokens:
        own = counts[g]
        if isinstance(special, tuple):
            own[0][LITERALS + _prefix(special[0])[0]] += 1
            own[4][_prefix(special[1])[0]] += 1
        elif special is not None:
            own[0][LITERALS + LENGTHS + special] += 1
        else:
            for c, v in zip(own, (p >> 8 & 255, p >> 16 & 255, p & 255, p >> 24)):
                c[v] += 1
    coded = []
    for own in counts:
        lengths = [code_lengths(c) for c in own]
        for l in lengths:
            write_code(out, l)
        coded.append([([0] * len(l), [0] * len(l)) if sum(map(bool, l)) == 1 else (canonical(l), l) for l in lengths])

    def put(code, s: int, extra: int = 0, k: int = 0) -> None:
        codes, lengths = code
        out.bits(codes[s] | extra << lengths[s], lengths[s] + k)

    for g, special, p in tokens:
        own = coded[g]
        if isinstance(special, tuple):
            for code, value, base in ((own[0], special[0], LITERALS), (own[4], special[1], 0)):
                s, extra, k = _prefix(value)
                put(code, base + s, extra, k)
        elif special is not None:
            put(own[0], LITERALS + LENGTHS + special)
        else:
            for code, v in zip(own, (p >> 8 & 255, p >> 16 & 255, p & 255, p >> 24)):
                put(code, v)


def wrap(stream: bytes) -> bytes:
    """The file of a VP8L stream."""
    pad = b"\0" * (len(stream) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(stream) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream + pad


def encode(pixels: np.ndarray, transforms: tuple[int, ...] = (), cache_bits: int = 0, references: bool = False, tile_bits: int = 0, block_bits: int = 2) -> bytes:
    """A file of pixels [height, width, 4]; the options choose the parts of the format that it uses."""
    height, width = pixels.shape[:2]
    flat = pixels.reshape(-1, 4).astype(np.int64)
    line = (flat[:, 3] << 24 | flat[:, 1] << 16 | flat[:, 0] << 8 | flat[:, 2]).tolist()
    out, across = Writer(), width
    for value, n in ((SIGNATURE, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        out.bits(value, n)
    for kind in transforms:
        out.bits(1, 1)
        out.bits(kind, 2)
        blocks = (across + (1 << block_bits) - 1) >> block_bits, (height + (1 << block_bits) - 1) >> block_bits
        if kind == PREDICTOR:
            modes = [i % 14 for i in range(blocks[0] * blocks[1])]
            out.bits(block_bits - 2, 3)
            _write_image(out, [m << 8 for m in modes], blocks[0], False)
            minus = lambda a, b: ((a | 0x00FF00FF) - (b & 0xFF00FF00) & 0xFF00FF00) | ((a | 0xFF00FF00) - (b & 0x00FF00FF) & 0x00FF00FF)
            line = [minus(p, _mode_at(line, at, across, modes[(at // across >> block_bits) * blocks[0] + (at % across >> block_bits)])) & 0xFFFFFFFF for at, p in enumerate(line)]
        elif kind == CROSS_COLOUR:
            elements = [(37 * i & 255) << 16 | (101 * i + 9 & 255) << 8 | (53 * i + 3 & 255) for i in range(blocks[0] * blocks[1])]
            out.bits(block_bits - 2, 3)
            _write_image(out, elements, blocks[0], False)
            line = _cross(line, across, block_bits, elements, -1)
        elif kind == SUBTRACT_GREEN:
            line = _green(line, -1)
        else:
            colours = sorted(set(line))
            if len(colours) > 256:
                raise ValueError("too many colours for a palette")
            out.bits(len(colours) - 1, 8)
            deltas = [_add(c, _add(~b & 0xFFFFFFFF, 0x01010101)) for b, c in zip([0, *colours], colours)]
            _write_image(out, deltas, len(colours), False)
            pack = _packing(len(colours))
            index, narrow, packed = {c: i for i, c in enumerate(colours)}, (across + (1 << pack) - 1) >> pack, []
            for y in range(height):
                row = [index[p] for p in line[y * across : (y + 1) * across]]
                for x in range(0, across, 1 << pack):
                    packed.append(0xFF000000 | sum(v << (8 >> pack) * k for k, v in enumerate(row[x : x + (1 << pack)])) << 8)
            line, across = packed, narrow
    out.bits(0, 1)
    _write_image(out, line, across, True, cache_bits, references, tile_bits)
    return wrap(out.done())


# ---- many images at once

#: Longest code that encode_batch uses: a token, four of them or a reference with its extra bits, fits into a 64-bit window.
BATCH_LENGTH = 12
#: Pixels of the shortest reference, the longest one, and the farthest distance.
SHORTEST, LONGEST, FARTHEST = 3, 4096, (1 << 20) - 120
#: Bits of a header that a further symbol of a code costs, about.
SYMBOL_BITS = 5
#: Lanes from which on each is read to its end by itself.
ALONE = 40
#: Colours up to which a palette packs several pixels into one.
FEW = 16


def shape(n: int) -> tuple[int, int]:
    """(width, height) of an image for n > 0 pixels, n a multiple of 16; it may hold more."""
    rows = n // 16
    wide = -(-rows // LARGEST)
    return 16 * wide, -(-rows // wide)


def _prefixes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_prefix() of many values."""
    v = values - 1
    top = np.maximum(np.log2(np.maximum(v, 1)).astype(np.int64), 1)
    small = v < 4
    extra = np.where(small, 0, top - 1)
    return np.where(small, v, 2 * top + (v >> (top - 1) & 1)), np.where(small, 0, v & ((1 << extra) - 1)), extra


def _repeats(pixels: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, lengths, distances) of the references of all images, greedy from the left.

    The candidate of a pixel is the last place where it and its neighbour stood
    together; places in a row with one distance make up a match.
    """
    n = len(pixels)
    if n < 2:
        return (np.empty(0, np.int64),) * 3
    pair = pixels[:-1].astype(np.uint64) | pixels[1:].astype(np.uint64) << np.uint64(32)
    key = (pair ^ (pair >> np.uint64(29)) ^ image[:-1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    order = np.argsort(key, kind="stable")
    far = np.zeros(n - 1, np.int64)
    now, then = order[1:], order[:-1]
    same = (pair[now] == pair[then]) & (image[now] == image[then]) & (image[now] == image[now + 1]) & (image[then] == image[then + 1])
    far[now[same]] = (now - then)[same]
    far[far > FARTHEST] = 0
    place = np.arange(n - 1)
    stops = np.append(np.diff(far) != 0, True)
    length = np.where(far > 0, 2 + np.minimum.accumulate(np.where(stops, place, n)[::-1])[::-1] - place, 0)
    found = np.flatnonzero(length >= SHORTEST)
    starts, end = [], 0
    for at, k in zip(found.tolist(), np.minimum(length[found], LONGEST).tolist()):
        if at >= end:
            starts.append(at)
            end = at + k
    starts = np.array(starts, np.int64)
    return starts, np.minimum(length[starts], LONGEST), far[starts]


def _cost(code: np.ndarray, image: np.ndarray, n: int, size: int) -> np.ndarray:
    """Bits of each image's symbols by the entropy of its own code, and of that code's header, about."""
    counts = np.bincount(image * size + code, minlength=n * size).reshape(n, size).astype(np.float64)
    total = counts.sum(axis=1)
    held = np.where(counts > 0, counts, 1)
    return total * np.log2(np.maximum(total, 1)) - (counts * np.log2(held)).sum(axis=1) + SYMBOL_BITS * (counts > 0).sum(axis=1)


def encode_batch(payloads: list[bytes]) -> list[bytes]:
    """A file of each payload, whose length is a positive multiple of 64: four bytes a pixel.

    Repeats become references.  Each image has a colour cache if that makes it
    smaller, and images of few colours a palette that packs their pixels; those
    go through encode() with the transforms that make them smallest.
    """
    shapes = [shape(len(p) // 4) for p in payloads]
    sizes = np.array([4 * w * h for w, h in shapes], np.int64)
    data = np.frombuffer(b"".join(p.ljust(n, b"\0") for p, n in zip(payloads, sizes.tolist())), np.uint8).reshape(-1, 4)
    n, n_pixels = len(payloads), sizes // 4
    image = np.repeat(np.arange(n), n_pixels)
    green, red, blue, alpha = (data[:, k].astype(np.int64) for k in range(4))
    pixels = (alpha << 24 | red << 16 | green << 8 | blue).astype(np.uint32)
    # the cache holds each slot's last pixel, however that was coded
    bits = np.where(n_pixels >= 1024, 9, 7)
    slot = (pixels.astype(np.int64) * CACHE_FACTOR & 0xFFFFFFFF) >> (32 - bits[image])
    order = np.argsort(image << 11 | slot, kind="stable")
    hit = np.zeros(len(pixels), bool)
    hit[order[1:]] = (pixels[order[1:]] == pixels[order[:-1]]) & (image[order[1:]] == image[order[:-1]]) & (slot[order[1:]] == slot[order[:-1]])
    starts, lengths, distances = _repeats(pixels, image)
    inside = np.zeros(len(pixels) + 1, np.int64)
    inside[starts] += 1
    np.add.at(inside, starts + lengths, -1)
    inside = np.cumsum(inside[:-1]) > 0
    is_ref = np.zeros(len(pixels), bool)
    is_ref[starts] = True
    reach = np.zeros(len(pixels), np.int64)
    reach[starts] = np.arange(len(starts))
    token = np.flatnonzero(~inside | is_ref)
    own, ref, cached = image[token], is_ref[token], hit[token] & ~is_ref[token]
    length_code, length_extra, length_bits = _prefixes(lengths)
    far_code, far_extra, far_bits = _prefixes(distances + len(NEAR))
    size = LITERALS + LENGTHS + (1 << 9)
    first = green[token]
    first[ref] = LITERALS + length_code[reach[token[ref]]]
    with_cache = np.where(cached, LITERALS + LENGTHS + slot[token], first)
    rest = np.stack([red[token], blue[token], alpha[token]], axis=1)
    plain = _cost(first, own, n, size) + _cost(rest[~ref].ravel(), np.repeat(own[~ref], 3), n, 256)
    saved = plain > _cost(with_cache, own, n, size) + _cost(rest[~ref & ~cached].ravel(), np.repeat(own[~ref & ~cached], 3), n, 256)
    cached &= saved[own]
    first = np.where(cached, with_cache, first)
    literal = ~ref & ~cached
    counts = np.bincount(own * size + first, minlength=n * size).reshape(n, size)
    others = np.bincount(np.repeat(own[literal], 3) * 256 + rest[literal].ravel(), minlength=n * 256).reshape(n, 256)
    fars = np.bincount(image[starts] * DISTANCES + far_code, minlength=n * DISTANCES).reshape(n, DISTANCES)
    tables = [(np.zeros((n, k), np.int64), np.zeros((n, k), np.uint64)) for k in (size, 256, DISTANCES)]
    heads = []
    for i, (width, height) in enumerate(shapes):
        head = Writer()
        for value, k in ((SIGNATURE, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3), (0, 1), (int(saved[i]), 1)):
            head.bits(value, k)
        if saved[i]:
            head.bits(int(bits[i]), 4)
        head.bits(0, 1)
        alphabet = LITERALS + LENGTHS + (1 << int(bits[i]) if saved[i] else 0)
        written = []
        for (length, code), n_of in zip(tables, (counts[i, :alphabet], others[i], fars[i])):
            made = code_lengths(n_of.tolist(), BATCH_LENGTH)
            part = Writer()
            write_code(part, made)
            written.append(part)
            if sum(map(bool, made)) > 1:
                length[i, : len(made)], code[i, : len(made)] = made, canonical(made)
        for part in (written[0], written[1], written[1], written[1], written[2]):
            head.bits(part.value, part.size)
        heads.append(head)
    length, code = tables[0][0][own, first], tables[0][1][own, first]
    more = np.where(literal)[0]
    for k in range(3):
        code[more] |= tables[1][1][own[more], rest[more, k]] << length[more].astype(np.uint64)
        length[more] += tables[1][0][own[more], rest[more, k]]
    if len(starts):
        at, of = np.flatnonzero(ref), image[starts]
        for value, k in ((length_extra, length_bits), (tables[2][1][of, far_code], tables[2][0][of, far_code]), (far_extra, far_bits)):
            code[at] |= value.astype(np.uint64) << length[at].astype(np.uint64)
            length[at] += k
    n_tokens = np.bincount(own, minlength=n)
    last = np.cumsum(n_tokens)
    total = np.concatenate(([0], np.cumsum(length)))
    head_bits = np.array([h.size for h in heads])
    places = np.concatenate(([0], np.cumsum(-(-(head_bits + total[last] - total[last - n_tokens]) // 8))))
    begin = places[:-1] * 8 + head_bits - total[last - n_tokens]
    at = total[:-1] + np.repeat(begin, n_tokens)
    code <<= (at & 7).astype(np.uint64)
    out = np.zeros(int(places[-1]) + 8, np.float64)
    for k in range(8):  # bits don't overlap, so sums are unions
        part = (code >> np.uint64(8 * k) & np.uint64(255)).astype(np.float64)
        held = np.flatnonzero(part)
        out += np.bincount((at[held] >> 3) + k, part[held], len(out))
    out = out.astype(np.uint8)
    for i, h in enumerate(heads):
        part = np.frombuffer(h.done(), np.uint8)
        out[places[i] : places[i] + len(part)] |= part
    whole = out.tobytes()
    files = [wrap(whole[a:b]) for a, b in zip(places[:-1].tolist(), places[1:].tolist())]
    ends = np.cumsum(n_pixels)
    for i in np.flatnonzero(n_pixels <= 4096):
        own_pixels = data[ends[i] - n_pixels[i] : ends[i]]
        if len(np.unique(pixels[ends[i] - n_pixels[i] : ends[i]])) <= FEW:
            tried = [encode(own_pixels.reshape(shapes[i][1], shapes[i][0], 4), kinds, references=True) for kinds in ((PALETTE,), (SUBTRACT_GREEN,), (PREDICTOR,), (CROSS_COLOUR,))]
            files[i] = min([files[i], *tried], key=len)
    return files


def _lane(body: bytes) -> tuple | None:
    """(width, height, transforms, coded width, cache bits, five code tables, place of the pixels) of a stream, or None if its codes come in tiles or are too long for a window.

    A code that repeats bit by bit is read once.
    """
    bits = Reader(body[1:8192])
    if body[0] != SIGNATURE:
        return None
    width, height = bits.bits(14) + 1, bits.bits(14) + 1
    if bits.bits(4) & ~1:
        return None
    undo, across = _transforms(bits, width, height)
    cache_bits = bits.bits(4) if bits.bits(1) else 0
    if cache_bits > 11 or bits.bits(1):
        return None
    codes, before, text = [], 0, None
    for size in (LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES):
        start = bits.at
        if before and size == 256 and start + before <= bits.size and (bits.value >> start) & ((1 << before) - 1) == text:
            codes.append(codes[-1])
            bits.at = start + before
            continue
        codes.append(lookup(read_code(bits, size)))
        before = bits.at - start
        text = (bits.value >> start) & ((1 << before) - 1)
    if sum(w for _, w in codes[:4]) > 56:
        return None
    return width, height, undo, across, cache_bits, codes, bits.at + 8


def _rest(body: bytes, at: int, found: tuple, out: np.ndarray, done: int, cache: np.ndarray) -> None:
    """Read one lane from bit `at` of its body on: out has its first `done` pixels, cache is its colour cache."""
    _, _, _, across, cache_bits, codes, _ = found
    (green, g), (red, r), (blue, b), (alpha, a), (far, f) = ((t.tolist(), (1 << w) - 1) for t, w in codes)
    body, pixels, held, total, shift = body + bytes(16), out[:done].tolist(), cache.tolist(), len(out), 32 - cache_bits
    stop = 8 * (len(body) - 16)

    def valued(symbol: int) -> int:
        nonlocal at
        if symbol < 4:
            return symbol + 1
        extra = (symbol - 2) >> 1
        value = ((2 + (symbol & 1)) << extra) + (int.from_bytes(body[at >> 3 : (at >> 3) + 5], "little") >> (at & 7) & ((1 << extra) - 1)) + 1
        at += extra
        return value

    while len(pixels) < total:
        bits = int.from_bytes(body[at >> 3 : (at >> 3) + 8], "little") >> (at & 7)
        entry = green[bits & g]
        n, symbol = entry & 15, entry >> 4
        if symbol < LITERALS:
            bits >>= n
            x = red[bits & r]
            bits >>= x & 15
            y = blue[bits & b]
            bits >>= y & 15
            z = alpha[bits & a]
            at += n + (x & 15) + (y & 15) + (z & 15)
            pixel = z >> 4 << 24 | x >> 4 << 16 | symbol << 8 | y >> 4
            pixels.append(pixel)
            held[(CACHE_FACTOR * pixel & 0xFFFFFFFF) >> shift] = pixel
        elif symbol >= LITERALS + LENGTHS:
            at += n
            pixels.append(held[symbol - LITERALS - LENGTHS])
        else:
            at += n
            length = valued(symbol - LITERALS)
            entry = far[int.from_bytes(body[at >> 3 : (at >> 3) + 4], "little") >> (at & 7) & f]
            at += entry & 15
            back = distance_of(valued(entry >> 4), across)
            if back > len(pixels) or len(pixels) + length > total:
                raise ValueError("a reference leaves the image")
            for _ in range(length):
                pixel = pixels[-back]
                pixels.append(pixel)
                held[(CACHE_FACTOR * pixel & 0xFFFFFFFF) >> shift] = pixel
        if at > stop:
            raise ValueError("the stream ends early")
    out[done:] = pixels[done:]


def decode_batch(files: list[bytes]) -> list[np.ndarray]:
    """The pixels of each file.  Streams with one group of codes are read in step with each other, a token of each at a time; others one by one."""
    out: list = [None] * len(files)
    lanes = []
    for i, data in enumerate(files):
        body = chunk(data)
        try:
            found = _lane(body)
        except (ValueError, IndexError):  # a header longer than the window for it, or a damaged one, which decode() tells
            found = None
        if found is None:
            out[i] = decode(data)
        else:
            lanes.append((i, body, found))
    if not lanes:
        return out
    data = np.frombuffer(b"".join(b for _, b, _ in lanes) + bytes(24), np.uint8)
    window = np.zeros(len(data) - 8, np.uint64)
    for k in range(8):
        window |= data[k : k + len(window)].astype(np.uint64) << np.uint64(8 * k)
    limit = 8 * (len(data) - 16)
    # rows of the lanes' state: place of the bits, next pixel, end, first pixel, cache bits, cache, then start and mask of five tables
    state = np.zeros((16, len(lanes)), np.int64)
    begins_at = (8 * np.cumsum([0] + [len(b) for _, b, _ in lanes])[:-1]).tolist()
    state[0] = np.array(begins_at) + [f[6] for _, _, f in lanes]
    pixels = np.array([f[3] * f[1] for _, _, f in lanes])
    state[2] = np.cumsum(pixels)
    state[1] = state[3] = state[2] - pixels
    state[4] = [f[4] for _, _, f in lanes]
    state[5] = np.cumsum(1 << state[4]) - (1 << state[4])
    cache = np.zeros(int((1 << state[4]).sum()), np.uint32)
    tables, known, size = [], {}, 0
    for lane, (_, _, found) in enumerate(lanes):
        for c, (table, width) in enumerate(found[5]):
            if id(table) not in known:
                known[id(table)] = size
                tables.append(table)
                size += len(table)
            state[6 + 2 * c, lane], state[7 + 2 * c, lane] = known[id(table)], (1 << width) - 1
    table = np.concatenate(tables)
    result = np.zeros(int(state[2, -1]), np.uint32)
    firsts, ends = state[3].copy(), state[2].copy()

    def read(at: np.ndarray) -> np.ndarray:
        if at.max() > limit:
            raise ValueError("the stream ends early")
        return (window[at >> 3] >> (at & 7).astype(np.uint64)).astype(np.int64) & 0x1FFFFFFFFFFFFFF

    def valued(at: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value, bits taken) of prefix symbols whose extra bits stand at `at`."""
        extra = np.where(symbol < 4, 0, (symbol - 2) >> 1)
        return np.where(symbol < 4, symbol + 1, ((2 + (symbol & 1)) << extra) + (read(at) & ((1 << extra) - 1)) + 1), extra

    def remember(lane: np.ndarray, values: np.ndarray) -> None:
        slot = (values.astype(np.int64) * CACHE_FACTOR & 0xFFFFFFFF) >> (32 - state[4, lane])
        cache[state[5, lane] + slot] = values  # of equal slots the last one stays

    while state.shape[1] > ALONE:
        bits = read(state[0])
        entry = table[state[6] + (bits & state[7])].astype(np.int64)
        symbol, taken = entry >> 4, entry & 15
        state[0] += taken
        lane = np.flatnonzero(symbol < LITERALS)
        if len(lane):
            rest, used, value = bits[lane] >> taken[lane], 0, symbol[lane] << 8
            for c, shift in ((8, 16), (10, 0), (12, 24)):
                entry = table[state[c, lane] + (rest & state[c + 1, lane])].astype(np.int64)
                rest >>= entry & 15
                used = used + (entry & 15)
                value |= entry >> 4 << shift
            result[state[1, lane]] = value
            remember(lane, value.astype(np.uint32))
            state[0, lane] += used
            state[1, lane] += 1
        lane = np.flatnonzero(symbol >= LITERALS + LENGTHS)
        if len(lane):
            # the pixel is in its slot already
            result[state[1, lane]] = cache[state[5, lane] + symbol[lane] - LITERALS - LENGTHS]
            state[1, lane] += 1
        lane = np.flatnonzero((symbol >= LITERALS) & (symbol < LITERALS + LENGTHS))
        if len(lane):
            n, extra = valued(state[0, lane], symbol[lane] - LITERALS)
            at = state[0, lane] + extra
            entry = table[state[14, lane] + (read(at) & state[15, lane])].astype(np.int64)
            back, extra = valued(at + (entry & 15), entry >> 4)
            state[0, lane] = at + (entry & 15) + extra
            near = np.flatnonzero(back <= len(NEAR))
            codes, back = back[near], back - len(NEAR)
            for k, code in zip(near, codes.tolist()):
                back[k] = distance_of(code, lanes[int(np.searchsorted(ends, state[2, lane[k]]))][2][3])
            row = state[1, lane]
            if (back > row - state[3, lane]).any() or (row + n > state[2, lane]).any():
                raise ValueError("a reference leaves the image")
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            # a copy that overlaps itself repeats its first pixels
            copied = result[np.repeat(row - back, n) + step % np.repeat(back, n)]
            result[np.repeat(row, n) + step] = copied
            remember(np.repeat(lane, n), copied)
            state[1, lane] += n
        done = state[1] >= state[2]
        if done.any():
            state = state[:, ~done]
    for k in range(state.shape[1]):
        own = int(np.searchsorted(ends, state[2, k]))
        at, upto, end, begin, cache_bits, place = state[:6, k].tolist()
        _rest(lanes[own][1], at - begins_at[own], lanes[own][2], result[begin:end], upto - begin, cache[place : place + (1 << cache_bits)])
    for (i, _, (width, height, undo, *_)), a, b in zip(lanes, firsts.tolist(), ends.tolist()):
        out[i] = _samples(_inverted(result[a:b].tolist(), undo, height) if undo else result[a:b], width, height)
    return out
