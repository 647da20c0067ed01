"""Media columns as lossless WebP: a full reader of the bit stream, a reader of many images at once, and a writer."""

from __future__ import annotations

import heapq
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import slices

#: Fixed values of the format: the order in which lengths of the code-length code are stored, the alphabets, the cache's multiplier.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
LITERALS, LENGTH_CODES, DISTANCE_CODES = 256, 24, 40
CACHE_FACTOR = 0x1E35A7BD
#: Near pixels by distance code: (dx to the left, dy up), nearest first; of equal distances the smaller |dx|, then the one to the left.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y > 0 or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))
#: The writer's images: width, rows of a frame at most, longest code of the green samples, shortest run that it writes as a copy.
WIDTH, ROWS, LONGEST, RUN = 576, 32, 11, 64
UNIT = 576


class Bits:
    """The bits of a stream, least significant first."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        if not n:
            return 0
        byte, shift = self.at >> 3, self.at & 7
        self.at += n
        return (int.from_bytes(self.data[byte : byte + 8], "little") >> shift) & ((1 << n) - 1)


#: Numbers of 15 bits with their bits in reverse order.
FLIPPED = sum(((np.arange(1 << 15) >> k) & 1) << (14 - k) for k in range(15))


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols that have a code, in the order of their codes, with lengths and codes (first bit lowest, as stored)."""
    symbols = np.flatnonzero(lengths)
    symbols = symbols[np.argsort(lengths[symbols], kind="stable")]
    sizes = lengths[symbols].astype(np.int64)
    top = int(sizes[-1])
    steps = 1 << (top - sizes)  # codes as numbers of `top` bits follow each other
    codes = (np.cumsum(steps) - steps) >> (top - sizes)
    return symbols, sizes, FLIPPED[codes] >> (15 - sizes)


class Code:
    """A prefix code: by the next `bits` bits, 16 * symbol + length. A code of one symbol has length 0."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        there = np.flatnonzero(lengths)
        if len(there) < 2:
            self.bits, self.table = 0, np.array([16 * (int(there[0]) if len(there) else 0)], dtype=np.int32)
            return
        symbols, sizes, codes = canonical(lengths)
        if int((1 << (15 - sizes)).sum()) != 1 << 15:
            raise ValueError("a prefix code is not complete")
        self.bits = int(sizes[-1])
        self.table = np.empty(1 << self.bits, dtype=np.int32)
        for size in np.unique(sizes).tolist():  # a code of `size` bits stands at each index that ends with it
            own = sizes == size
            self.table.reshape(-1, 1 << size)[:, codes[own]] = 16 * symbols[own] + size
        self.rows: list[int] | None = None

    def read(self, bits: Bits) -> int:
        if not self.bits:
            return int(self.table[0]) >> 4
        if self.rows is None:
            self.rows = self.table.tolist()
        byte, shift = bits.at >> 3, bits.at & 7
        entry = self.rows[(int.from_bytes(bits.data[byte : byte + 4], "little") >> shift) & ((1 << self.bits) - 1)]
        bits.at += entry & 15
        return entry >> 4


def read_code(bits: Bits, size: int) -> Code:
    lengths = np.zeros(size, dtype=np.int64)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Code(lengths)
    own = np.zeros(19, dtype=np.int64)
    for k in LENGTH_ORDER[: 4 + bits.read(4)]:
        own[k] = bits.read(3)
    most = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    code, found, last = Code(own), [], 8
    while len(found) < size and most:
        most -= 1
        k = code.read(bits)
        if k < 16:
            found.append(k)
            last = k or last
        elif k == 16:
            found += [last] * (3 + bits.read(2))
        else:
            found += [0] * (3 + bits.read(3) if k == 17 else 11 + bits.read(7))
    if len(found) > size:
        raise ValueError("more code lengths than symbols")
    lengths[: len(found)] = found
    return Code(lengths)


def read_value(bits: Bits, prefix: int) -> int:
    """The length or distance that a prefix symbol and its extra bits stand for."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def distance(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


@dataclass
class Image:
    """What stands before the pixels of an image: its transforms, prefix codes, and the place where the pixels begin."""

    width: int
    height: int
    transforms: list[tuple] = field(default_factory=list)
    packed: int = 0  # the width of the stored pixels
    cache: int = 0
    block: int = 0
    groups: list[list[Code]] = field(default_factory=list)
    group_of: np.ndarray | None = None
    at: int = 0


def read_codes(bits: Bits, image: Image, main: bool) -> None:
    image.cache = bits.read(4) if bits.read(1) else 0
    if main and bits.read(1):
        image.block = bits.read(3) + 2
        w, h = -(-image.packed >> image.block), -(-image.height >> image.block)
        image.group_of = ((read_sub(bits, w, h) >> 8) & 0xFFFF).reshape(h, w)
    n = 1 + int(image.group_of.max()) if image.group_of is not None else 1
    green = LITERALS + LENGTH_CODES + (1 << image.cache if image.cache else 0)
    image.groups = [[read_code(bits, size) for size in (green, 256, 256, 256, DISTANCE_CODES)] for _ in range(n)]
    image.at = bits.at


def read_sub(bits: Bits, width: int, height: int) -> np.ndarray:
    image = Image(width, height, packed=width)
    read_codes(bits, image, main=False)
    return read_pixels(bits, image)


def read_pixels(bits: Bits, image: Image) -> np.ndarray:
    """The stored pixels as 0xAARRGGBB, one by one: literals, copies and colours of the cache."""
    width, total = image.packed, image.packed * image.height
    out: list[int] = []
    cache = [0] * (1 << image.cache) if image.cache else None
    shift, cached = 32 - image.cache, 0

    def fill() -> None:
        nonlocal cached
        for argb in out[cached:]:
            cache[(CACHE_FACTOR * argb & 0xFFFFFFFF) >> shift] = argb
        cached = len(out)

    while len(out) < total:
        group = image.groups[0] if image.group_of is None else image.groups[image.group_of[len(out) // width >> image.block, len(out) % width >> image.block]]
        s = group[0].read(bits)
        if s < LITERALS:
            red, blue, alpha = group[1].read(bits), group[2].read(bits), group[3].read(bits)
            out.append(alpha << 24 | red << 16 | s << 8 | blue)
        elif s < LITERALS + LENGTH_CODES:
            size = read_value(bits, s - LITERALS)
            back = distance(read_value(bits, group[4].read(bits)), width)
            start = len(out) - back
            if start < 0:
                raise ValueError("a copy from before the image")
            while size > 0:
                part = out[start : start + size]
                out += part
                size -= len(part)
        else:
            fill()
            out.append(cache[s - LITERALS - LENGTH_CODES])
        if len(out) > total:
            raise ValueError("more pixels than the image has")
    return np.array(out, dtype=np.uint32)


def read_head(data: bytes) -> Image:
    """The image of a VP8L chunk, up to its pixels."""
    bits = Bits(data)
    if bits.read(8) != 0x2F:
        raise ValueError("not a lossless image")
    image = Image(bits.read(14) + 1, bits.read(14) + 1)
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    image.packed = image.width
    while bits.read(1):
        kind = bits.read(2)
        if kind < 2:
            block = bits.read(3) + 2
            w, h = -(-image.packed >> block), -(-image.height >> block)
            image.transforms.append((kind, block, image.packed, read_sub(bits, w, h).reshape(h, w)))
        elif kind == 2:
            image.transforms.append((kind,))
        else:
            size = bits.read(8) + 1
            deltas = read_sub(bits, size, 1)
            planes = [np.cumsum((deltas >> s) & 0xFF) & 0xFF for s in (0, 8, 16, 24)]
            image.transforms.append((kind, sum(p.astype(np.uint32) << np.uint32(s) for p, s in zip(planes, (0, 8, 16, 24), strict=True)), image.packed))
            image.packed = -(-image.packed >> (3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0))
    read_codes(bits, image, main=True)
    return image


def unpredict(argb: np.ndarray, block: int, modes: np.ndarray) -> np.ndarray:
    """Inverts the predictor transform; argb has the shape (height, width)."""
    height, width = argb.shape
    px = np.stack([(argb >> s) & 0xFF for s in (0, 8, 16, 24)], axis=-1).astype(np.int64)  # B, G, R, A
    black = np.array([0, 0, 0, 255])
    px[0, 0] = (px[0, 0] + black) & 255
    px[0, 1:] = px[0, 1:] & 255
    px[0] = np.cumsum(px[0], axis=0) & 255
    for y in range(1, height):
        up = px[y - 1]
        row = px[y]
        row[0] = (row[0] + up[0]) & 255
        for x in range(1, width):
            mode = int(modes[y >> block, x >> block] >> 8) & 15
            left, top, corner = row[x - 1], up[x], up[x - 1]
            right = up[x + 1] if x + 1 < width else row[0]
            if mode == 0 or mode > 13:
                guess = black
            elif mode <= 4:
                guess = (left, top, right, corner)[mode - 1]
            elif mode == 5:
                guess = ((left + right) // 2 + top) // 2
            elif mode == 10:
                guess = ((left + corner) // 2 + (top + right) // 2) // 2
            elif mode < 10:
                a, b = {6: (left, corner), 7: (left, top), 8: (corner, top), 9: (top, right)}[mode]
                guess = (a + b) // 2
            elif mode == 11:
                guess = left if np.abs(top - corner).sum() < np.abs(left - corner).sum() else top
            elif mode == 12:
                guess = np.clip(left + top - corner, 0, 255)
            else:
                mean = (left + top) // 2
                guess = np.clip(mean + np.fix((mean - corner) / 2).astype(np.int64), 0, 255)
            row[x] = (row[x] + guess) & 255
    return sum(px[..., k].astype(np.uint32) << np.uint32(s) for k, s in enumerate((0, 8, 16, 24)))


def recolour(argb: np.ndarray, block: int, factors: np.ndarray) -> np.ndarray:
    """Inverts the cross-colour transform."""
    height, width = argb.shape
    each = np.repeat(np.repeat(factors, 1 << block, axis=0)[:height], 1 << block, axis=1)[:, :width].astype(np.int64)
    signed = lambda v: ((v & 0xFF) ^ 0x80) - 0x80
    red_to_blue, green_to_blue, green_to_red = signed(each >> 16), signed(each >> 8), signed(each)
    x = argb.astype(np.int64)
    green = signed(x >> 8)
    red = ((x >> 16) + ((green_to_red * green) >> 5)) & 0xFF
    blue = (x + ((green_to_blue * green) >> 5) + ((red_to_blue * signed(red)) >> 5)) & 0xFF
    return ((x & 0xFF00FF00) | red << 16 | blue).astype(np.uint32)


def invert(image: Image, argb: np.ndarray) -> np.ndarray:
    """The pixels (height, width) from the stored ones, by the image's transforms, last first."""
    argb = argb.reshape(image.height, image.packed)
    for t in reversed(image.transforms):
        if t[0] == 0:
            argb = unpredict(argb, t[1], t[3])
        elif t[0] == 1:
            argb = recolour(argb, t[1], t[3])
        elif t[0] == 2:
            green = (argb >> 8) & 0xFF
            argb = (argb & 0xFF00FF00) | (((argb >> 16) + green) & 0xFF) << 16 | ((argb + green) & 0xFF)
        else:
            palette, width = t[1], t[2]
            bits = 3 if len(palette) <= 2 else 2 if len(palette) <= 4 else 1 if len(palette) <= 16 else 0
            index = (argb >> 8) & 0xFF
            if bits:
                each = 8 >> bits
                index = ((index[:, :, None] >> (np.arange(1 << bits, dtype=np.uint32) * each)) & ((1 << each) - 1)).reshape(image.height, -1)[:, :width]
            argb = np.where(index < len(palette), palette[np.minimum(index, len(palette) - 1)], 0).astype(np.uint32)
    return argb.astype(np.uint32)


def chunks(data: bytes, at: int) -> Iterator[tuple[bytes, bytes]]:
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        yield kind, data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)


def frames(data: bytes) -> tuple[int, int, list[tuple[int, int, bytes]]]:
    """Width, height and the (x, y, VP8L data) of the frames of a file; a still image has one."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    width = height = 0
    found = []
    u24 = lambda b: int.from_bytes(b[:3], "little")
    for kind, body in chunks(data, 12):
        if kind == b"VP8X":
            width, height = u24(body[4:]) + 1, u24(body[7:]) + 1
        elif kind == b"ANMF":
            found += [(2 * u24(body), 2 * u24(body[3:]), inner) for k, inner in chunks(body, 16) if k == b"VP8L"]
        elif kind == b"VP8L":
            found.append((0, 0, body))
            word = int.from_bytes(body[1:5], "little")
            width, height = width or (word & 0x3FFF) + 1, height or ((word >> 14) & 0x3FFF) + 1
    return width, height, found


def decode_frame(data: bytes) -> np.ndarray:
    image = read_head(data)
    bits = Bits(data)
    bits.at = image.at
    return invert(image, read_pixels(bits, image))


def decode(data: bytes) -> np.ndarray:
    """The pixels of a file as 0xAARRGGBB (height, width), frame by frame and pixel by pixel."""
    return decode_many([data])[0]


def even(image: Image) -> bool:
    """Whether each stored pixel is a green symbol alone, by one code: then images can be read side by side."""
    return not image.cache and image.group_of is None and not any(c.bits for c in image.groups[0][1:4])


def read_pixels_together(images: list[Image], data: list[bytes]) -> list[np.ndarray]:
    """The stored pixels of many even images: each step reads one symbol of every image."""
    sizes = np.array([i.packed * i.height for i in images], dtype=np.int64)
    slack, stride = 64, 32
    outs = np.concatenate(([0], np.cumsum(sizes + slack)))
    out = np.zeros(int(outs[-1]), dtype=np.uint16)  # 16 * symbol + length of its code
    raw = np.frombuffer(b"".join([*data, bytes(64)]), dtype=np.uint8)
    peek = np.zeros(len(raw) - 3, dtype=np.uint32)
    for k in range(4):
        peek |= raw[k : len(raw) - 3 + k].astype(np.uint32) << np.uint32(8 * k)
    pos = np.cumsum([0, *[len(d) for d in data[:-1]]]) * 8 + np.array([i.at for i in images])
    codes = [i.groups[0] for i in images]
    tables = np.cumsum([0, *[len(c[0].table) for c in codes[:-1]]])
    table = np.concatenate([c[0].table for c in codes]).astype(np.uint16)
    masks = np.array([(1 << c[0].bits) - 1 for c in codes], dtype=np.uint32)
    at, end = outs[:-1].copy(), outs[:-1] + sizes
    lane, last = np.arange(len(images)), len(raw) * 8 - 64
    while len(lane):
        p, o, t, m, stop = pos[lane], at[lane], tables[lane], masks[lane], end[lane]
        for _ in range(stride):
            window = peek.take(p >> 3, mode="clip")
            window >>= (p & 7).astype(np.uint32)
            window &= m
            entry = table.take(window + t, mode="clip")
            out[o] = entry
            p += entry & 15
            o += 1
            if entry.max() >= 16 * LITERALS:
                for k in np.flatnonzero((entry >= 16 * LITERALS) & (o <= stop)).tolist():
                    group, base, to = codes[lane[k]], int(p[k]) >> 3, int(o[k]) - 1
                    bits = Bits(raw[base : base + 64].tobytes())
                    bits.at = int(p[k]) & 7
                    size = read_value(bits, (int(entry[k]) >> 4) - LITERALS)
                    back = distance(read_value(bits, group[4].read(bits)), images[lane[k]].packed)
                    if to - back < outs[lane[k]] or to + size > stop[k]:
                        raise ValueError("a copy from outside the image")
                    for done in range(0, size, back):
                        part = min(back, size - done)
                        out[to + done : to + done + part] = out[to - back : to - back + part]
                    o[k] = to + size
                    p[k] = 8 * base + bits.at
            np.minimum(p, last, out=p)
            np.minimum(o, stop + (slack - 2), out=o)
        pos[lane], at[lane] = p, o
        lane = lane[o < stop]
    rest = [sum(int(c[k].table[0]) >> 4 << s for k, s in ((1, 16), (2, 0), (3, 24))) for c in codes]
    return [(out[a : a + n] >> 4).astype(np.uint32) << np.uint32(8) | np.uint32(r) for a, n, r in zip(outs[:-1].tolist(), sizes.tolist(), rest, strict=True)]


def decode_many(files: list[bytes], most: int = 8_000_000) -> list[np.ndarray]:
    """The pixels of each file (height, width). Frames whose pixels are one symbol each are read side by side."""
    heads, parts = [], []
    for data in files:
        width, height, found = frames(data)
        heads.append((np.zeros((height, width), dtype=np.uint32), [(x, y, len(parts) + k) for k, (x, y, _) in enumerate(found)]))
        parts += [body for _, _, body in found]
    images = [read_head(body) for body in parts]
    pixels: list[np.ndarray | None] = [None] * len(parts)
    together = [k for k, i in enumerate(images) if even(i)]
    together.sort(key=lambda k: images[k].packed * images[k].height)
    while together:  # a bounded number of pixels and tables at a time
        now, held = [], 0
        while together and held < most and len(now) < 1024:
            now.append(together.pop())
            held += images[now[-1]].packed * images[now[-1]].height
        for k, px in zip(now, read_pixels_together([images[k] for k in now], [parts[k] for k in now]), strict=True):
            pixels[k] = px
    for k, (image, body) in enumerate(zip(images, parts, strict=True)):
        if pixels[k] is None:
            bits = Bits(body)
            bits.at = image.at
            pixels[k] = read_pixels(bits, image)
    for canvas, places in heads:
        for x, y, k in places:
            px = invert(images[k], pixels[k])
            canvas[y : y + px.shape[0], x : x + px.shape[1]] = px
    return [canvas for canvas, _ in heads]


# ---- writing


def code_lengths(counts: np.ndarray, longest: int) -> np.ndarray:
    """Lengths of an optimal prefix code; counts are flattened until none is longer than `longest`."""
    lengths = np.zeros(len(counts), dtype=np.int64)
    there = np.flatnonzero(counts)
    if len(there) < 2:
        lengths[there] = 1
        return lengths
    weights = counts[there].tolist()
    while True:
        heap = [(w, k) for k, w in enumerate(weights)]
        heapq.heapify(heap)
        parent, nodes = {}, len(weights)
        while len(heap) > 1:
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            parent[i] = parent[j] = nodes
            heapq.heappush(heap, (a + b, nodes))
            nodes += 1
        depth = [0] * nodes
        for k in range(nodes - 2, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth[: len(weights)]) <= longest:
            lengths[there] = depth[: len(weights)]
            return lengths
        weights = [(w + 1) // 2 for w in weights] if max(weights) > 2 else [1] * len(weights)


class Writer:
    """Bits, least significant first, as one growing number for headers."""

    def __init__(self):
        self.value = self.at = 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.at
        self.at += n

    def code(self, lengths: np.ndarray) -> None:
        """A prefix code by its lengths."""
        there = np.flatnonzero(lengths)
        if len(there) <= 2 and (not len(there) or there[-1] < 256):
            first = int(there[0]) if len(there) else 0
            self.put(1, 1)
            self.put(len(there) == 2, 1)
            self.put(first > 1, 1)
            self.put(first, 8 if first > 1 else 1)
            if len(there) == 2:
                self.put(int(there[1]), 8)
            return
        runs: list[tuple[int, int, int]] = []  # symbol, extra bits, their number
        at, n = 0, int(there[-1]) + 1
        values = lengths.tolist()
        while at < n:
            if values[at]:
                runs.append((values[at], 0, 0))
                at += 1
                continue
            zeros = 1
            while not values[at + zeros]:
                zeros += 1
            at += zeros
            while zeros >= 11:
                k = min(zeros, 138)
                runs.append((18, k - 11, 7))
                zeros -= k
            if zeros >= 3:
                runs.append((17, zeros - 3, 3))
                zeros = 0
            runs += [(0, 0, 0)] * zeros
        own = code_lengths(np.bincount([r[0] for r in runs], minlength=19), 7)
        codes = dict(zip(*(x.tolist() for x in canonical(own)[::2]), strict=True)) if (own > 0).sum() > 1 else None
        self.put(0, 1)
        used = max(k for k, s in enumerate(LENGTH_ORDER) if own[s]) + 1
        self.put(max(used, 4) - 4, 4)
        for s in LENGTH_ORDER[: max(used, 4)]:
            self.put(int(own[s]), 3)
        self.put(1, 1)  # the number of symbols follows
        self.put(3, 3)
        self.put(len(runs) - 2, 8) if 2 <= len(runs) < 258 else self._long(len(runs))
        for s, extra, n in runs:
            if codes is not None:
                self.put(codes[s], int(own[s]))
            self.put(extra, n)

    def _long(self, runs: int) -> None:
        self.value &= (1 << (self.at - 3)) - 1
        self.at -= 3
        self.put(7, 3)
        self.put(max(runs - 2, 0), 16)

    def literals(self, argb: list[int]) -> None:
        """A small image of its own prefix codes, without cache, groups and copies."""
        planes = [[(p >> s) & 255 for p in argb] for s in (8, 16, 0, 24)]
        sizes = [256 + LENGTH_CODES, 256, 256, 256]
        lengths = [code_lengths(np.bincount(p, minlength=n), 15) for p, n in zip(planes, sizes, strict=True)]
        for each in lengths:
            self.code(each)
        self.code(np.zeros(DISTANCE_CODES, dtype=np.int64))
        tables = [dict(zip(*(x.tolist() for x in canonical(each)[::2]), strict=True)) if (each > 0).sum() > 1 else None for each in lengths]
        for pixel in zip(*planes, strict=True):
            for v, each, codes in zip(pixel, lengths, tables, strict=True):
                if codes is not None:
                    self.put(codes[v], int(each[v]))


def run_pieces(samples: np.ndarray) -> list[tuple[int, int]]:
    """Start and length of the parts that repeat the sample before them, RUN or more, at most 4096 each."""
    if len(samples) <= RUN:
        return []
    change = np.flatnonzero(samples[1:] != samples[:-1]) + 1
    starts = np.concatenate(([0], change))
    sizes = np.diff(np.concatenate((starts, [len(samples)]))) - 1
    found = []
    for s, n in zip((starts[sizes >= RUN] + 1).tolist(), sizes[sizes >= RUN].tolist(), strict=True):
        found += [(s + k, min(4096, n - k)) for k in range(0, n, 4096)]
    return found


def encode_frame(samples: np.ndarray) -> bytes:
    """The VP8L data of samples (height, WIDTH) as the green channel; with at most 16 values, through a palette."""
    height, width = samples.shape
    head = Writer()
    head.put(0x2F, 8)
    head.put(width - 1, 14)
    head.put(height - 1, 14)
    head.put(0, 4)
    values = np.flatnonzero(np.bincount(samples.ravel(), minlength=256))
    alpha = 255
    if len(values) <= 16:
        head.put(1, 1)
        head.put(3, 2)
        head.put(len(values) - 1, 8)
        head.put(0, 1)
        steps = np.diff(np.concatenate(([0], values)))
        head.literals([(255 << 24 if not k else 0) | int(d & 255) << 8 for k, d in enumerate(steps)])
        bits = 3 if len(values) <= 2 else 2 if len(values) <= 4 else 1
        index = np.searchsorted(values, samples).reshape(height, -1, 1 << bits)
        samples = (index << (np.arange(1 << bits) * (8 >> bits))).sum(axis=-1)
    flat = samples.ravel().astype(np.int64)
    head.put(0, 1)  # no further transform
    head.put(0, 2)  # neither cache nor groups
    copies = run_pieces(flat)
    symbols, extra, widths = flat, None, None
    if copies:
        keep = np.ones(len(flat), dtype=bool)
        symbols, extra, widths = flat.copy(), np.zeros(len(flat), dtype=np.int64), np.zeros(len(flat), dtype=np.int64)
        for start, n in copies:
            keep[start + 1 : start + n] = False
            if n <= 4:
                symbols[start] = LITERALS + n - 1
            else:
                top = (n - 1).bit_length() - 1
                symbols[start] = LITERALS + 2 * top + ((n - 1) >> (top - 1) & 1)
                widths[start], extra[start] = top - 1, (n - 1) & ((1 << (top - 1)) - 1)
        symbols, extra, widths = symbols[keep], extra[keep], widths[keep]
    lengths = code_lengths(np.bincount(symbols, minlength=LITERALS + LENGTH_CODES), LONGEST)
    head.code(lengths)
    one = np.zeros(256, dtype=np.int64)
    one[0] = 1
    full = np.zeros(256, dtype=np.int64)
    full[alpha] = 1
    near = np.zeros(DISTANCE_CODES, dtype=np.int64)
    near[1] = 1  # the pixel to the left
    for each in (one, one, full, near):
        head.code(each)
    codes = np.zeros(LITERALS + LENGTH_CODES, dtype=np.int64)
    if (lengths > 0).sum() > 1:
        order, sizes, found = canonical(lengths)
        codes[order] = found
    else:
        lengths = np.zeros_like(lengths)
    sizes, bits = lengths[symbols], codes[symbols]
    if extra is not None:
        bits = bits | extra << sizes
        sizes = sizes + widths
    return place_bits(head, bits, sizes)


def place_bits(head: Writer, bits: np.ndarray, sizes: np.ndarray) -> bytes:
    """The header's bits, then all of bits[i] with sizes[i] bits each."""
    ends = np.cumsum(sizes) + head.at
    total = int(ends[-1]) if len(ends) else head.at
    words = np.zeros(total // 32 + 2, dtype=np.uint64)
    starts = ends - sizes
    shifted = bits.astype(np.uint64) << (starts & 31).astype(np.uint64)
    word = starts >> 5
    # places only grow: the sum over the symbols of a word is a difference of running sums
    low, high = np.cumsum(shifted & np.uint64(0xFFFFFFFF)), np.cumsum(shifted >> np.uint64(32))
    lasts = np.flatnonzero(np.concatenate((word[1:] != word[:-1], [True]))) if len(word) else np.zeros(0, dtype=np.int64)
    words[word[lasts]] += np.diff(low[lasts], prepend=np.uint64(0))
    words[word[lasts] + 1] += np.diff(high[lasts], prepend=np.uint64(0))
    data = bytearray(words.astype("<u4").tobytes()[: (total + 7) // 8])
    front = head.value.to_bytes((head.at + 7) // 8, "little")
    for k, b in enumerate(front):
        data[k] |= b
    return bytes(data)


def chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + bytes(len(body) & 1)


def encode(payload: bytes) -> bytes:
    """A WebP file of the payload, a positive multiple of UNIT bytes, one pixel's green sample a byte, row by row.

    Up to ROWS rows are a still image; more are an animation whose frames stand below each other, ROWS rows each.
    """
    samples = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    parts = [chunk(b"VP8L", encode_frame(samples[y : y + ROWS])) for y in range(0, len(samples), ROWS)]
    if len(parts) == 1:
        body = parts[0]
    else:
        u24 = lambda v: v.to_bytes(3, "little")
        body = chunk(b"VP8X", bytes([2, 0, 0, 0]) + u24(WIDTH - 1) + u24(len(samples) - 1)) + chunk(b"ANIM", bytes(6))
        for k, part in enumerate(parts):
            rows = min(ROWS, len(samples) - k * ROWS)
            body += chunk(b"ANMF", u24(0) + u24(k * ROWS // 2) + u24(WIDTH - 1) + u24(rows - 1) + u24(100) + bytes([2]) + part)
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WEBP" + body


# ---- columns


def padded(raw: bytes) -> bytes:
    return raw + b"\xff" * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def feature(samples: np.ndarray) -> str:
    """Which of 64 equal stretches of the samples are brighter than their median, as 16 hexadecimal digits."""
    means = samples.reshape(64, -1).mean(axis=1)
    return np.packbits(means > np.median(means)).tobytes().hex()


def with_media(docs: DataFrame, text: str = "text", to: str = "media") -> DataFrame:
    """docs with the column `to`: the text's UTF-8 bytes, padded with 255 to a positive multiple of UNIT, as a WebP file.

    A null text counts as empty. Every row stays, repeated rows too; a column of that name is replaced. Equal texts have
    equal files, and texts of any length are stored whole.
    """
    docs = docs.drop(to)
    names = docs.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{to}` binary"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            files = [encode(padded((t or "").encode())) for t in batch.column(names.index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(files, pa.binary())], names=[*names, to])

    return docs.mapInArrow(run, schema)


def pixels(media: DataFrame, column: str = "media", to: str = "pixels") -> DataFrame:
    """media with the column `to`: struct of width, height and the pixels' bytes, 4 each (little-endian 0xAARRGGBB); null files: null."""
    media = media.drop(to)
    names = media.columns
    kind = pa.struct([("width", pa.int32()), ("height", pa.int32()), ("argb", pa.binary())])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema), f"`{to}` struct<width: int, height: int, argb: binary>"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column, 1_000_000):
            files = batch.column(names.index(column)).to_pylist()
            there = [k for k, f in enumerate(files) if f is not None]
            out: list[dict | None] = [None] * len(files)
            for k, px in zip(there, decode_many([files[k] for k in there]), strict=True):
                out[k] = {"width": px.shape[1], "height": px.shape[0], "argb": px.astype("<u4").tobytes()}
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], names=[*names, to])

    return media.mapInArrow(run, schema)


def digests(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature of the file read back.

    A null or empty text is one unit of padding; null ids stay null; equal texts, and repeated rows, have equal values; very long
    texts are stored and read whole, as frames of ROWS rows; an empty table gives no rows; columns of docs may have any name.
    """
    import hashlib

    kinds = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media", 5_000_000):
            files = batch.column(2).to_pylist()
            out: dict[str, list] = {k: [] for k in kinds}
            for n, data, px in zip(batch.column(1).to_pylist(), files, decode_many(files), strict=True):
                samples = ((px >> 8) & 0xFF).astype(np.uint8).ravel()
                raw = samples.tobytes()
                row = (n, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(samples))
                for k, v in zip(kinds, row, strict=True):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(out[k], kind) for k, kind in kinds.items()]], names=[id_col, *kinds])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text).cast("string").alias(text), F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long").alias("n_bytes"))
    stored = with_media(rows, text).select(id_col, "n_bytes", "media")
    return stored.mapInArrow(run, f"`{id_col}` long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
