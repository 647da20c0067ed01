import base64
import hashlib
import zlib

import numpy as np
import pytest

from eventloom.llm import webp
from eventloom.llm.queries import op4_webp

RNG = np.random.default_rng(5)


class Full(webp.Writer):
    """A writer of streams with every feature of the format, for the reader's tests only."""

    def body(self, argb, width, cache=0, block=0, main=True):
        """Pixels as literals, copies and cache entries, with groups of codes by blocks if block > 0."""
        height = len(argb) // width
        self.put(cache > 0, 1)
        if cache:
            self.put(cache, 4)
        groups = 1
        if main:
            self.put(block > 0, 1)
            if block:
                w, h = -(-width >> block), -(-height >> block)
                groups = 3
                self.put(block - 2, 3)
                which = [k % groups for k in range(w * h)]
                self.body([0xFF000000 | g << 8 for g in which], w, main=False)
        group_at = lambda k: which[(k // width >> block) * w + (k % width >> block)] if block else 0
        table, steps, k = [0] * (1 << cache), [], 0
        while k < len(argb):
            slot = (webp.CACHE_FACTOR * argb[k] & 0xFFFFFFFF) >> (32 - cache) if cache else 0
            back = next((d for d in (1, width, 3) if k >= d and argb[k] == argb[k - d]), 0)
            size = 1
            if back:
                while k + size < len(argb) and size < 40 and argb[k + size] == argb[k + size - back]:
                    size += 1
            if back and size > 2:
                code = next((i + 1 for i, (x, y) in enumerate(webp.NEAR) if max(1, x + y * width) == back), back + 120)
                steps.append((group_at(k), "copy", size, code))
            elif cache and table[slot] == argb[k]:
                size = 1
                steps.append((group_at(k), "cache", slot, 0))
            else:
                size = 1
                steps.append((group_at(k), "pixel", argb[k], 0))
            for p in argb[k : k + size]:
                if cache:
                    table[(webp.CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - cache)] = p
            k += size

        def prefix(v):
            if v <= 4:
                return v - 1, 0, 0
            top = (v - 1).bit_length() - 1
            return 2 * top + ((v - 1) >> (top - 1) & 1), (v - 1) & ((1 << (top - 1)) - 1), top - 1

        sizes = (280 + (1 << cache if cache else 0), 256, 256, 256, 40)
        emitted = []
        for g, kind, value, code in steps:
            if kind == "pixel":
                symbols = [(0, value >> 8 & 255), (1, value >> 16 & 255), (2, value & 255), (3, value >> 24)]
                emitted.append((g, [(c, s, 0, 0) for c, s in symbols]))
            elif kind == "cache":
                emitted.append((g, [(0, 280 + value, 0, 0)]))
            else:
                (a, x, n), (b, y, m) = prefix(value), prefix(code)
                emitted.append((g, [(0, 256 + a, x, n), (4, b, y, m)]))
        counts = [[np.zeros(n, dtype=np.int64) for n in sizes] for _ in range(groups)]
        for g, symbols in emitted:
            for c, s, _, _ in symbols:
                counts[g][c][s] += 1
        lengths = [[webp.code_lengths(c, 15) for c in group] for group in counts]
        for group in lengths:
            for each in group:
                self.code(each)
        tables = [[dict(zip(*(x.tolist() for x in webp.canonical(each)[::2]))) if (each > 0).sum() > 1 else None for each in group] for group in lengths]
        for g, symbols in emitted:
            for c, s, extra, n in symbols:
                if tables[g][c] is not None:
                    self.put(tables[g][c][s], int(lengths[g][c][s]))
                self.put(extra, n)


def head(width, height):
    out = Full()
    out.put(0x2F, 8)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(1, 1)
    out.put(0, 3)
    return out


def data(writer):
    return writer.value.to_bytes((writer.at + 7) // 8, "little")


def picture(width, height):
    y, x = np.mgrid[0:height, 0:width]
    planes = [(x * 7 + y * 3) % 256, (x * y) % 256, (x // 4 * 40 + RNG.integers(0, 3, x.shape)) % 256, 255 - (y // 5)]
    return sum(p.astype(np.uint32) << np.uint32(8 * k) for k, p in enumerate(planes))


def forward_predict(px, block, modes):
    """Residuals by plain loops over channels, written from the format's definition."""
    height, width = px.shape
    channel = lambda v, k: (int(v) >> 8 * k) & 255
    out = np.zeros_like(px)
    for y in range(height):
        for x in range(width):
            parts = []
            for k in range(4):
                at = lambda yy, xx: channel(px[yy, xx], k)  # noqa: B023, E731
                if x == y == 0:
                    guess = 255 if k == 3 else 0
                elif y == 0:
                    guess = at(0, x - 1)
                elif x == 0:
                    guess = at(y - 1, 0)
                else:
                    left, top, corner = at(y, x - 1), at(y - 1, x), at(y - 1, x - 1)
                    right = at(y - 1, x + 1) if x + 1 < width else at(y, 0)
                    mode = modes[y >> block][x >> block]
                    if mode == 11:
                        pairs = [[channel(px[a], c) for c in range(4)] for a in ((y, x - 1), (y - 1, x), (y - 1, x - 1))]
                        to_left = sum(abs(p[1] - p[2]) for p in zip(*pairs))
                        to_top = sum(abs(p[0] - p[2]) for p in zip(*pairs))
                        guess = left if to_left < to_top else top
                    else:
                        half = (left + top) // 2
                        guess = {
                            0: 255 if k == 3 else 0, 1: left, 2: top, 3: right, 4: corner, 5: ((left + right) // 2 + top) // 2, 6: (left + corner) // 2, 7: half,
                            8: (corner + top) // 2, 9: (top + right) // 2, 10: ((left + corner) // 2 + (top + right) // 2) // 2,
                            12: min(255, max(0, left + top - corner)), 13: min(255, max(0, half + int((half - corner) / 2))),
                        }[mode]
                parts.append((at(y, x) - guess) & 255)
            out[y, x] = sum(p << 8 * k for k, p in enumerate(parts))
    return out


def test_predictor_cross_colour_and_green():
    px = picture(23, 17)
    block, modes = 2, [[(3 * i + j) % 14 for j in range(6)] for i in range(5)]
    factors = [[(i * 37 % 256, j * 91 % 256, (i + j) * 53 % 256) for j in range(6)] for i in range(5)]
    signed = lambda v: v - 256 if v > 127 else v
    crossed = np.zeros_like(px)
    for y in range(17):
        for x in range(23):
            r2b, g2b, g2r = map(signed, factors[y >> block][x >> block])
            a, r, g, b = (int(px[y, x]) >> s & 255 for s in (24, 16, 8, 0))
            new_r = (r - (g2r * signed(g) >> 5)) & 255
            new_b = (b - (g2b * signed(g) >> 5) - (r2b * signed(r) >> 5)) & 255
            crossed[y, x] = a << 24 | new_r << 16 | g << 8 | new_b
    residual = forward_predict(crossed, block, modes)
    green = (residual >> 8) & 255
    final = (residual & 0xFF00FF00) | (((residual >> 16) - green) & 255) << 16 | ((residual - green) & 255)
    out = head(23, 17)
    out.put(1, 1), out.put(1, 2), out.put(block - 2, 3)
    out.body([0xFF000000 | a << 16 | b << 8 | c for row in factors for a, b, c in row], 6, main=False)
    out.put(1, 1), out.put(0, 2), out.put(block - 2, 3)
    out.body([0xFF000000 | m << 8 for row in modes for m in row], 6, main=False)
    out.put(1, 1), out.put(2, 2)
    out.put(0, 1)
    out.body(final.ravel().tolist(), 23, cache=4, block=3)
    assert (webp.decode_frame(data(out)) == px).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 9, 16, 17, 200, 256])
@pytest.mark.parametrize("cache", [0, 6])
def test_palettes(colours, cache):
    palette = RNG.integers(0, 1 << 32, colours, dtype=np.uint32)
    index = RNG.integers(0, colours, (11, 13))
    bits = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    packed_width = -(-13 >> bits)
    packed = np.zeros((11, packed_width), dtype=np.int64)
    for x in range(13):
        packed[:, x >> bits] |= index[:, x] << ((x & ((1 << bits) - 1)) * (8 >> bits))
    out = head(13, 11)
    out.put(1, 1), out.put(3, 2), out.put(colours - 1, 8)
    deltas, last = [], 0
    for p in palette.tolist():
        deltas.append(sum(((p >> s) - (last >> s) & 255) << s for s in (0, 8, 16, 24)))
        last = p
    out.body(deltas, colours, main=False)
    out.put(0, 1)
    out.body([0xFF000000 | v << 8 for v in packed.ravel().tolist()], packed_width, cache=cache)
    body = data(out)
    file = b"RIFF" + (len(body) + 12).to_bytes(4, "little") + b"WEBP" + webp.chunk(b"VP8L", body)
    assert (webp.decode_frame(body) == palette[index]).all() and (webp.decode(file) == palette[index]).all()


def test_copies_and_cache():
    px = np.tile(RNG.integers(0, 1 << 32, 37, dtype=np.uint32), 20).reshape(20, 37)
    for cache, block in ((0, 0), (5, 0), (11, 2), (0, 2)):
        out = head(37, 20)
        out.put(0, 1)
        out.body(px.ravel().tolist(), 37, cache=cache, block=block)
        assert (webp.decode_frame(data(out)) == px).all()


def test_side_by_side_equals_one_by_one():
    files = [webp.encode(webp.padded(RNG.integers(0, top, n, dtype=np.uint8).tobytes() + b"a" * run)) for top, n, run in ((256, 3000, 0), (20, 40_000, 900), (2, 10, 5000), (90, 600, 64), (1, 0, 0))]
    for file, px in zip(files, webp.decode_many(files), strict=True):
        _, _, parts = webp.frames(file)
        assert (np.concatenate([webp.decode_frame(body) for _, _, body in parts]) == px).all()


def test_broken_files():
    for bad in (b"", b"RIFF\0\0\0\0WEBQ", b"RIFF\0\0\0\0WEBPVP8L\x05\0\0\0\x30\0\0\0\0"):
        with pytest.raises(ValueError):
            webp.decode(bad)


#: Published probes of one pixel, by which pages find out whether a browser reads lossless files, and a drawing of 1 x 1.
PROBES = ("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==", "UklGRh4AAABXRUJQVlA4TBEAAAAvAAAAAAfQ//73v/+BiOh/AAA=")


@pytest.mark.parametrize("probe", PROBES)
def test_published_files(probe):
    px = webp.decode(base64.b64decode(probe))
    assert px.shape == (1, 1)
    assert (webp.decode_many([base64.b64decode(probe)] * 3)[2] == px).all()


def expected(text):
    raw = (text or "").encode()
    payload = webp.padded(raw)
    assert len(payload) % 576 == 0 and payload.startswith(raw) and len(payload) > 0
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])


def digest(text):
    """All of a row's values but the id: the file is read pixel by pixel, and the feature computed in plain numbers."""
    raw = (text or "").encode()
    file = webp.encode(webp.padded(raw))
    _, _, parts = webp.frames(file)
    back = bytes(int(x) >> 8 & 255 for body in (b for _, _, b in parts) for x in webp.decode_frame(body).ravel())
    each = len(back) // 64
    means = [sum(back[k * each : (k + 1) * each]) / each for k in range(64)]
    low, high = sorted(means)[31:33]
    bits = "".join(str(int(m > (low + high) / 2)) for m in means)
    return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(file), hashlib.sha256(file).hexdigest(), f"{int(bits, 2):016x}"


def test_all_columns_equal_plain_ones(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 1500 or text is null").limit(40)
    rows = {r["doc_id"]: tuple(r)[1:] for r in webp.digests(docs).collect()}
    assert rows == {r["doc_id"]: digest(r["text"]) for r in docs.collect()}


def test_query(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op4_webp(spark, sf_dir).collect()
    assert len(rows) == len(texts) and all(tuple(r)[1:5] == expected(texts[r["doc_id"]]) for r in rows)


def test_odd_rows(odd_docs, no_docs, clashing):
    rows = webp.digests(clashing).collect()
    assert sorted(tuple(r)[1:5] for r in rows) == sorted(expected(r["text"]) for r in odd_docs.collect())
    assert webp.digests(no_docs).count() == 0
    for r in webp.pixels(webp.with_media(clashing)).collect():
        argb = np.frombuffer(r["pixels"]["argb"], dtype="<u4")
        assert r["pixels"]["width"] == 576 and (argb >> 8 & 255).astype(np.uint8).tobytes() == webp.padded((r["text"] or "").encode())
