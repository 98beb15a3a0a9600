"""Word and character shingles as 64-bit hashes, and MinHash signatures, with numpy.

A hash stands for its shingle: two of a pair's shingles are confused with a chance near
2^-64, so sets of hashes are compared in place of sets of strings.
"""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.default_rng(20240229)
#: One random number for each byte, and odd multipliers.
BYTE_VALUE = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
STEP = np.uint64(int(_RANDOM.integers(0, 2**61)) * 4 + 5)
BACK = np.uint64(pow(int(STEP), -1, 2**64))
PLACE = _RANDOM.integers(0, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept for the next call."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        _powers[name] = have = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes data[start:end] of each span, by one running sum over all bytes."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * _power("step", STEP, len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power("back", BACK, len(data) + 1)[starts])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the border of each text in the list of words."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~IS_SPACE[data]
    breaks = np.zeros(len(data) + 1, bool)
    breaks[offsets] = True
    starts = np.flatnonzero(inside & (breaks[:-1] | np.r_[True, ~inside[:-1]]))
    ends = np.flatnonzero(inside & (breaks[1:] | np.r_[~inside[1:], True])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_shingles(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``width`` words of each text (A-Z lowered), and the texts' borders.

    A text with fewer words has one shingle, its whole sequence; one without words has none.
    """
    starts, ends, at = words(data, offsets)
    hashes = span_hashes(LOWER[data], starts, ends) if len(starts) else np.zeros(0, np.uint64)
    return _runs(hashes, at, width)


def char_shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of eight bytes of each text as 64-bit numbers, spread by a bijection.

    A text of one to seven bytes is one shingle of its bytes and their number.
    """
    run = np.zeros(len(data) + 8, np.uint64)
    run[: len(data)] = data
    for width in (1, 2, 4):
        run[:-width] |= run[width:] << np.uint64(8 * width)
    lengths = np.diff(offsets)
    short = (lengths > 0) & (lengths < 8)
    counts = np.where(short, 1, np.maximum(lengths - 7, 0))
    borders = np.r_[0, np.cumsum(counts)]
    first = np.repeat(offsets[:-1] - borders[:-1], counts) + np.arange(borders[-1])
    out = run[first]
    if short.any():
        size = lengths[short].astype(np.uint64)
        at = borders[:-1][short]
        kept = out[at] & ((np.uint64(1) << (size * np.uint64(8))) - np.uint64(1))
        out[at] = kept | size << np.uint64(56)
    return mix(out), borders


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 texts as numbers, and the texts' borders among them."""
    if not len(data) or data.max() < 128:
        return data.astype(np.uint32), offsets
    lead = (data & 0xC0) != 0x80
    at = np.r_[np.int32(0), np.cumsum(lead, dtype=np.int32)][offsets].astype(np.int64)
    try:
        return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32), at
    except UnicodeError:  # a text that is not UTF-8: each first byte with up to three that follow it
        starts = np.flatnonzero(lead)
        size = np.diff(np.r_[starts, len(data)])
        points = data[starts].astype(np.uint32) & np.array([0, 0x7F, 0x1F, 0x0F, 0x07], np.uint32)[np.minimum(size, 4)]
        for k in (1, 2, 3):
            longer = np.flatnonzero(size > k)
            points[longer] = points[longer] << np.uint32(6) | (data[starts[longer] + k] & 0x3F)
        return points, at


def _weighed(x: np.ndarray, at: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """At each place the sum of the numbers from there on, each times its factor.

    The last places of a text reach into the next one, except the first place of a text with fewer numbers.
    """
    out = x * factors[0]
    for k in range(1, min(len(factors), len(x))):
        out[:-k] += x[k:] * factors[k]
    counts = np.diff(at)
    short = np.flatnonzero((counts > 0) & (counts < len(factors)))
    if len(short):
        first, counts = at[short], counts[short]
        value = np.zeros(len(short), x.dtype)
        for k in range(len(factors) - 1):
            has = counts > k
            value[has] += x[first[has] + k] * factors[k]
        out[first] = value
    return out


def point_shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``width`` code points of each UTF-8 text, and the texts' borders.

    A text with fewer code points is one shingle; an empty one has none.
    """
    points, at = code_points(data, offsets)
    x = points.astype(np.uint64) + np.uint64(1)
    if width <= 3:  # three code points fit into 64 bits
        factors = np.array([1 << 21 * (width - 1 - k) for k in range(width)], np.uint64)
    else:
        x, factors = mix(x), _power("step", STEP, width)
    whole = np.ones(len(x), bool)
    for k in range(1, width):
        place = at[1:] - k
        whole[place[place > at[:-1]]] = False
    counts = np.diff(at)
    made = np.where((counts > 0) & (counts < width), 1, np.maximum(counts - width + 1, 0))
    return mix(_weighed(x, at, factors)[whole]), np.r_[0, np.cumsum(made)]


#: Odd factors of the places of a run.
_PLACES = _RANDOM.integers(0, 2**31, 16, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def _mix32(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def point_marks(points: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """32-bit hashes of the runs of ``width`` code points, as many as there are code points.

    The last places of each text, where no whole run begins, repeat its last run. So the least
    and the distinct marks of a text are those of its runs, and texts keep their borders.
    """
    marks = _mix32(_weighed(_mix32(points + np.uint32(1)), at, _PLACES[:width]))
    last = np.maximum(at[1:] - width, at[:-1])
    for k in range(1, width):
        place = at[1:] - k
        inside = place > last
        marks[place[inside]] = marks[last[inside]]
    return marks


def minima_of_marks(marks: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """``size`` MinHash coordinates, each from a multiplication of the marks by its own odd number."""
    return _minima(marks, at, size, _multiplied)


def _runs(hashes: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    counts = np.diff(at)
    short = (counts > 0) & (counts < width)
    made = np.where(short, 1, np.maximum(counts - width + 1, 0))
    borders = np.r_[0, np.cumsum(made)]
    out = np.zeros(borders[-1], np.uint64)
    owner = np.repeat(np.arange(len(counts)), made)
    first = at[owner] + np.arange(borders[-1]) - borders[owner]
    size = np.minimum(counts[owner], width)
    padded = np.r_[hashes, np.zeros(width, np.uint64)]
    for j in range(width):
        part = padded[first + j] * PLACE[j]
        out += part if not short.any() else np.where(j < size, part, np.uint64(0))
    return mix(out + size.astype(np.uint64)), borders


def sets(hashes: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of each text, and their borders."""
    parts = [np.unique(hashes[a:b]) for a, b in zip(borders[:-1], borders[1:], strict=True)]
    sizes = np.array([len(p) for p in parts], np.int64)
    return np.concatenate([np.zeros(0, np.uint64), *parts]), np.r_[0, np.cumsum(sizes)]


def set_keys(hashes: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """64 bits naming each set; 0 for an empty one."""
    sums = np.r_[np.uint64(0), np.cumsum(mix(hashes + np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64)]
    return (sums[borders[1:]] - sums[borders[:-1]]).view(np.int64)


def circulant_minhash(hashes: np.ndarray, borders: np.ndarray, size: int) -> np.ndarray:
    """``size`` MinHash coordinates of each nonempty text from two permutations of 2^32 numbers.

    The first permutation (the hash itself) places the shingles, the second is read after a
    circular shift by 1, 2, ... for the coordinates.
    """
    placed = (hashes >> np.uint64(32)).astype(np.uint32)
    return _minima(placed, borders, size, _shifted)


def _shifted(placed: np.ndarray, k: int, x: np.ndarray, y: np.ndarray) -> None:
    np.add(placed, np.uint32(k + 1), out=x)
    np.multiply(x, np.uint32(0x85EBCA6B), out=x)
    np.right_shift(x, np.uint32(15), out=y)
    np.bitwise_xor(x, y, out=x)
    np.multiply(x, np.uint32(0xC2B2AE35), out=x)
    np.right_shift(x, np.uint32(13), out=y)
    np.bitwise_xor(x, y, out=x)


_FACTORS = np.random.default_rng(7).integers(0, 2**31, 1024, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def _multiplied(placed: np.ndarray, k: int, x: np.ndarray, y: np.ndarray) -> None:
    np.multiply(placed, _FACTORS[k], out=x)


def linear_minhash(hashes: np.ndarray, borders: np.ndarray, size: int) -> np.ndarray:
    """``size`` MinHash coordinates, each from a multiplication of the hash by its own odd number."""
    placed = (hashes >> np.uint64(32)).astype(np.uint32)
    return _minima(placed, borders, size, _multiplied)


def _minima(placed: np.ndarray, borders: np.ndarray, size: int, permute, block: int = 1 << 16) -> np.ndarray:
    """Least permuted value of each text for each coordinate, in blocks that stay in the cache."""
    texts = len(borders) - 1
    out = np.full((size, texts), 0xFFFFFFFF, np.uint32)
    if not len(placed):
        return out.T
    full = np.flatnonzero(np.diff(borders) > 0)
    starts = borders[full]
    x, y = np.empty(block, np.uint32), np.empty(block, np.uint32)
    for a in range(0, len(placed), block):
        b = min(a + block, len(placed))
        i, j = np.searchsorted(starts, a, "right") - 1, np.searchsorted(starts, b)
        cuts = np.maximum(starts[i:j], a) - a
        part, px, py = placed[a:b], x[: b - a], y[: b - a]
        rows = full[i:j]
        for k in range(size):
            permute(part, k, px, py)
            out[k, rows] = np.minimum(out[k, rows], np.minimum.reduceat(px, cuts))
    return out.T


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` coordinates; bands differ in their keys."""
    texts, size = signature.shape
    parts = signature.reshape(texts, size // rows, rows).astype(np.uint64)
    key = np.arange(size // rows, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for r in range(rows):
        key = mix(key ^ parts[:, :, r] * PLACE[r % 8] + np.uint64(r + 1))
    return key.view(np.int64)
