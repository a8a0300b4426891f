"""Byte kernels on numpy: pure functions of one payload, without Spark."""

from __future__ import annotations

import hashlib

import numpy as np

U64 = np.uint64
FNV_PRIME = 1099511628211
FNV_BASIS = 14695981039346656037
# The alphabet of piecewise digests.
DIGEST_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
DIGEST_LENGTH = 64
ROLL_WINDOW = 7


def splitmix64(count: int, state: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A splitmix64 stream whose state steps before each draw."""
    step = U64(0x9E3779B97F4A7C15)
    x = U64(state) + step * np.arange(1, count + 1, dtype=U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def gear_table() -> np.ndarray:
    """A random 64-bit number for each byte value."""
    return splitmix64(256)


_GEAR = gear_table()


def histogram(data: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(data, np.uint8), minlength=256)


def chunk_lengths(data: bytes, least: int, most: int, mask: int) -> list[int]:
    """Content-defined chunks: a cut follows a byte at which the gear hash has no mask bit, from ``least`` bytes on.

    The low bits of the hash depend on as many last bytes as the mask has bits.  With
    ``least`` at or over that number a chunk's start can't be felt, so all candidate cuts
    are found at once; below it the hash runs byte by byte.
    """
    n, bits = len(data), mask.bit_length()
    if not n:
        return []
    b = np.frombuffer(data, np.uint8)
    if least < bits:
        return _chunks_by_byte(b.tolist(), least, most, mask)
    low = (_GEAR & U64(mask)).astype(np.int64)[b]
    h = low.copy()
    for a in range(1, min(bits, n)):
        h[a:] += low[: n - a] << a
    cuts = np.flatnonzero(h & mask == 0)
    out, start = [], 0
    while start < n:
        k = int(np.searchsorted(cuts, start + least - 1))
        end = min(int(cuts[k]) if k < len(cuts) else n - 1, start + most - 1, n - 1)
        out.append(end - start + 1)
        start = end + 1
    return out


def _chunks_by_byte(values: list[int], least: int, most: int, mask: int) -> list[int]:
    gear = [int(g) & mask for g in _GEAR]
    out, h, size = [], 0, 0
    for v in values:
        h = (h * 2 + gear[v]) & mask
        size += 1
        if size >= most or (size >= least and h == 0):
            out.append(size)
            h = size = 0
    return [*out, size] if size else out


def shingle_hashes(data: bytes, k: int) -> np.ndarray:
    """FNV-1a of every k-byte window; a shorter payload is one window; none for an empty one."""
    n = len(data)
    if not n:
        return np.empty(0, U64)
    width = min(k, n)
    b = np.frombuffer(data, np.uint8).astype(U64)
    h = np.full(n - width + 1, FNV_BASIS, U64)
    for j in range(width):
        h = (h ^ b[j : n - width + 1 + j]) * U64(FNV_PRIME)
    return h


def bottom_k(data: bytes, k: int, size: int) -> np.ndarray:
    """The ``size`` smallest distinct window hashes, unsigned, ascending."""
    h = shingle_hashes(data, k)
    if len(h) > 4 * size:
        # values beyond the kth smallest of all, with repeats, can still be needed: widen until enough are distinct
        want = 2 * size
        while want < len(h):
            low = np.unique(np.partition(h, want)[: want + 1])
            if len(low) > size:
                return low[:size]
            want *= 4
    return np.unique(h)[:size]


def ctph_block_size(n: int) -> int:
    return 3 << ((n // 64 + 1).bit_length() - 1)


def _roll(b: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte, from the last seven bytes alone."""
    total = np.zeros(len(b), np.int64)
    tilt = np.zeros(len(b), np.int64)
    shifted = np.zeros(len(b), np.int64)
    for a in range(min(ROLL_WINDOW, len(b))):
        c = np.zeros(len(b), np.int64)
        c[a:] = b[: len(b) - a]
        total += c
        tilt += (ROLL_WINDOW - a) * c
        shifted ^= (c << 5 * a) & 0xFFFFFFFF
    return (total + tilt + shifted) & 0xFFFFFFFF


def piecewise_digest(data: bytes, block: int, roll: np.ndarray | None = None) -> str:
    """A letter for each piece between rolling-hash triggers, 64 at most; letters need only six bits of the hash."""
    if not data:
        return ""
    b = np.frombuffer(data, np.uint8)
    roll = _roll(b.astype(np.int64)) if roll is None else roll
    hit = np.flatnonzero(roll % block == block - 1)
    ends = (hit[hit >= ROLL_WINDOW - 1] + 1)[:DIGEST_LENGTH].tolist()
    if len(ends) < DIGEST_LENGTH and (not ends or ends[-1] < len(data)):
        ends.append(len(data))
    return "".join(DIGEST_ALPHABET[x] for x in piece_states(b[: ends[-1]] & 63, np.array([0, *ends])).tolist())


def piece_states(low: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The low six bits of FNV-1a after each piece, bit by bit for all pieces at once.

    Bit j of the hash depends on lower bits alone: state' = (state ^ byte) * p modulo 2**(j+1).  Once the
    lower bits are known at every place, bit j changes by a known amount each step, as p is odd: a
    running sum of parities gives it.
    """
    starts, n = ends[:-1], len(low)
    before = np.zeros(n, np.uint8)  # known low bits of the state before each byte
    prime, basis = FNV_PRIME & 63, FNV_BASIS & 63
    final = np.zeros(len(starts), np.uint8)
    first = np.zeros(n + 1, np.uint8)
    for j in range(6):
        bit, below = 1 << j, (1 << j) - 1
        # what the lower bits carry into bit j, and the byte's own bit j
        carried = ((((before & below) ^ (low & below)).astype(np.int64) * prime) >> j).astype(np.uint8) ^ (low >> j)
        np.bitwise_xor.accumulate(carried & 1, out=first[1:])
        own = first[starts] ^ (basis >> j & 1)
        inside = first[:-1] ^ np.repeat(own, np.diff(ends))
        before |= (inside << j).astype(np.uint8)
        final |= ((first[ends[1:]] ^ own) * bit).astype(np.uint8)
    return final


def ctph_digest(data: bytes) -> str:
    """``size:pieces at size:pieces at twice the size``."""
    if not data:
        return "0::"
    block = ctph_block_size(len(data))
    roll = _roll(np.frombuffer(data, np.uint8).astype(np.int64))
    return f"{block}:{piecewise_digest(data, block, roll)}:{piecewise_digest(data, 2 * block, roll)}"


def block_entropy(data: bytes, block: int) -> np.ndarray:
    """Shannon entropy in bits a byte of each block, the last one as long as is left."""
    n = len(data)
    if not n:
        return np.empty(0)
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    if block >= n:
        counts, sizes = np.bincount(b, minlength=256)[None, :], np.array([n])
    else:
        of = np.arange(n) // block
        blocks = int(of[-1]) + 1
        counts = np.bincount(of * 256 + b, minlength=256 * blocks).reshape(blocks, 256)
        sizes = np.full(blocks, block)
        sizes[-1] = n - (blocks - 1) * block
    p = counts / sizes[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        bits = np.where(p > 0, -p * np.log2(p), 0.0)
    return bits.sum(axis=1)


def gram_table(data: bytes, length: int, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct windows of ``length`` bytes, a row of bytes each, how often each occurs, and where first; past ``most`` those first seen stay."""
    n = len(data)
    if length <= 0 or n < length:
        return np.empty((0, max(0, length)), np.uint8), np.empty(0, np.int64), np.empty(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), length)
    whole = np.ascontiguousarray(windows)
    if length == 16:  # two big-endian words sort as the bytes do, and faster
        words = whole.view(">u8").astype(U64)
        order = np.lexsort((words[:, 1], words[:, 0]))
        words = words[order]
        new = np.concatenate(([True], (words[1:] != words[:-1]).any(axis=1)))
        at = np.flatnonzero(new)
        first, counts = order[at], np.diff(np.append(at, len(order)))  # lexsort is stable: the first place leads
    else:
        _, first, counts = np.unique(whole.view(np.dtype((np.void, length))).ravel(), return_index=True, return_counts=True)
    if most is not None and len(first) > most:
        kept = np.sort(np.argsort(first, kind="stable")[:most])
        first, counts = first[kept], counts[kept]
    return whole[first], counts.astype(np.int64), first.astype(np.int64)


def gram_index(data: bytes, length: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit keys of the distinct windows, ascending, with counts and first offsets; past ``most`` those first seen stay."""
    if length <= 0 or len(data) < length:
        return np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int64)
    h = shingle_hashes(data, length)
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    keys, first, counts = np.unique(h, return_index=True, return_counts=True)
    if len(keys) > most:
        kept = np.sort(np.argsort(first, kind="stable")[:most])
        keys, first, counts = keys[kept], first[kept], counts[kept]
    return keys, counts.astype(np.int64), first.astype(np.int64)


def window_words(data: bytes, length: int) -> list[np.ndarray]:
    """The windows of ``length`` bytes as big-endian words, which sort as the bytes do: a word for every eight bytes, the last ones overlap."""
    n = max(0, len(data) - length + 1) if length > 0 else 0
    at = [*range(0, length - 8, 8), max(0, length - 8)]
    if not n:
        return [np.empty(0, U64) for _ in at]
    b = np.frombuffer(data + bytes(max(0, 8 - length)), np.uint8)
    eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(b, 8)).view(">u8").ravel().astype(U64)
    if length < 8:
        eight &= U64((1 << 64) - (1 << 8 * (8 - length)))
    return [eight[i : i + n] for i in at]


def word_bytes(words: list[np.ndarray], length: int) -> np.ndarray:
    """A row of bytes for each window of :func:`window_words`."""
    cells = np.empty((len(words[0]), max(0, length)), np.uint8)
    for i, w in zip([*range(0, length - 8, 8), max(0, length - 8)], words, strict=True):
        cells[:, i : i + 8] = np.ascontiguousarray(w).astype(">u8").view(np.uint8).reshape(-1, 8)[:, : max(0, min(8, length))]
    return cells


def word_hashes(words: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(words[0]), U64)
    for w in words:
        h = (h ^ w) * U64(0xD6E8FEB86659FD93)
        h ^= h >> U64(29)
    return h * U64(0x9E3779B97F4A7C15)


def equal_windows(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal windows stand together, by place, and where each kind begins there.  Hashes sort, bytes decide."""
    n, h = len(words[0]), word_hashes(words)
    if n <= 1 << 18:  # hash and place in one word
        bits = U64(max(1, n - 1).bit_length())
        h = (h >> bits << bits) | np.arange(n, dtype=U64)
        h.sort()
        order, h = (h & ((U64(1) << bits) - U64(1))).astype(np.int64), h >> bits
    else:
        order = np.argsort(h, kind="stable")
        h = h[order]
    same = h[1:] == h[:-1]
    at = np.flatnonzero(same)
    x, y = order[at], order[at + 1]
    if any((w[x] != w[y]).any() for w in words):  # different windows of one hash
        order = np.lexsort(words)
        same = np.logical_and.reduce([(s := w[order])[1:] == s[:-1] for w in words])
    return order, np.flatnonzero(np.concatenate((np.ones(min(1, n), bool), ~same)))


def met_windows(words: list[np.ndarray], at: np.ndarray, n_a: int, ends: tuple[int, int]) -> tuple[np.ndarray, ...]:
    """A row for each distinct window of two payloads: its place in ``words``, and its count and first offset on both sides.

    The first ``n_a`` windows are a's; ``at`` has their offsets, ascending on each side.  A side's windows first seen at its end or later are left out.
    """
    if not len(at):
        return (np.empty(0, np.int64),) * 5
    order, starts = equal_windows(words)
    n = np.diff(np.append(starts, len(order)))
    count_b = np.add.reduceat((order >= n_a).astype(np.int64), starts)
    count_a = n - count_b
    first_a, first_b = at[order[starts]], at[order[np.minimum(starts + count_a, len(order) - 1)]]
    count_a[first_a >= ends[0]] = 0
    count_b[first_b >= ends[1]] = 0
    kept = (count_a > 0) | (count_b > 0)
    return tuple(x[kept] for x in (order[starts], count_a, first_a, count_b, first_b))


def distinct_end(data: bytes, length: int, most: int) -> int:
    """The offset at which a window is the first beyond ``most`` distinct ones; past all offsets where none is."""
    n = max(0, len(data) - length + 1)
    if n > most and length > 0:
        order, starts = equal_windows(window_words(data, length))
        if len(starts) > most:
            return int(np.sort(order[starts])[most])
    return n


def best_windows(data: bytes, length: int, first: np.ndarray, weight: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` windows of largest weight; windows of one weight in the order of their bytes."""
    if not len(weight) or most <= 0:
        return np.empty(0, np.int64)
    if len(weight) > most:
        least = np.partition(weight, len(weight) - most)[len(weight) - most]
        near = np.flatnonzero(weight >= least)
    else:
        near = np.arange(len(weight))
    b = np.frombuffer(data, np.uint8)
    cells = b[first[near][:, None] + np.arange(length)]
    return near[np.lexsort((*cells.T[::-1], -weight[near]))][:most]


def sha256_upper(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest().upper()


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    """Cosine of two histograms, 0 where one is empty."""
    x, y = a.astype(float), b.astype(float)
    down = float(np.sqrt((x * x).sum()) * np.sqrt((y * y).sum()))
    return min(1.0, max(0.0, float((x * y).sum()) / down)) if down > 0 else 0.0
