"""Kernels against plain sequential versions."""

import math
import random

import numpy as np
import pytest

from siftmark.functions import kernels as K
from siftmark.options import next_pow2
from tests.payloads import pseudo, seeded

FULL = (1 << 64) - 1


def plain_fnv(data):
    h = K.FNV_BASIS
    for b in data:
        h = ((h ^ b) * K.FNV_PRIME) & FULL
    return h


def plain_chunks(data, least, most, mask):
    gear, out, h, size = [int(g) for g in K.gear_table()], [], 0, 0
    for b in data:
        h = ((h << 1) + gear[b]) & FULL
        size += 1
        if (size >= least and h & mask == 0) or size >= most:
            out.append(size)
            h = size = 0
    return out + [size] * (size > 0)


def plain_digest(data, block):
    window, at, h1, h2, h3, out, piece, pending = [0] * 7, 0, 0, 0, 0, "", K.FNV_BASIS, False
    for i, b in enumerate(data):
        h2 = (h2 - h1 + 7 * b) & 0xFFFFFFFF
        h1 = (h1 + b - window[at]) & 0xFFFFFFFF
        window[at] = b
        at = (at + 1) % 7
        h3 = ((h3 << 5) & 0xFFFFFFFF) ^ b
        piece, pending = ((piece ^ b) * K.FNV_PRIME) & FULL, True
        if i >= 6 and ((h1 + h2 + h3) & 0xFFFFFFFF) % block == block - 1:
            if len(out) < 64:
                out += K.DIGEST_ALPHABET[piece & 63]
            piece, pending = K.FNV_BASIS, False
            if len(out) == 64:
                return out
    return out + K.DIGEST_ALPHABET[piece & 63] * (pending and len(out) < 64)


BUFFERS = [b"", b"\x01", b"abc", bytes(500), bytes(range(256)) * 9, pseudo(20_000, 3), seeded(3001, 7), b"ab" * 4000]


def test_gear_table_ends():
    assert [hex(int(K.gear_table()[i])) for i in (0, 255)] == ["0x6e789e6aa1b965f4", "0xcbdc6d34b7c7534d"]


@pytest.mark.parametrize("least,most,avg", [(512, 8192, 2048), (64, 256, 64), (2, 100, 64), (1, 1, 16), (1, 50, 1), (6, 300, 64)])
def test_chunks(least, most, avg):
    mask = next_pow2(avg) - 1
    for data in BUFFERS:
        assert K.chunk_lengths(data, least, most, mask) == plain_chunks(data, least, most, mask)


@pytest.mark.parametrize("k", [1, 3, 8, 20])
def test_shingles_and_sketch(k):
    for data in BUFFERS:
        windows = [data[i : i + k] for i in range(len(data) - k + 1)] if len(data) >= k else [data] * bool(data)
        want = [plain_fnv(w) for w in windows]
        assert K.shingle_hashes(data, k).tolist() == want
        for size in (1, 16, 128):
            assert K.bottom_k(data, k, size).tolist() == sorted(set(want))[:size]


def test_digest():
    for data in BUFFERS:
        if data:
            block = 3 * 2 ** int(math.floor(math.log2(len(data) // 64 + 1)))
            assert K.ctph_block_size(len(data)) == block
            assert K.ctph_digest(data) == f"{block}:{plain_digest(data, block)}:{plain_digest(data, 2 * block)}"
    assert K.ctph_digest(b"") == "0::"
    assert len(K.piecewise_digest(pseudo(20_000, 5), 3)) == 64


@pytest.mark.parametrize("block", [1, 7, 256, 10**12])
def test_block_entropy(block):
    for data in BUFFERS:
        want = []
        for i in range(0, len(data), block):
            part = data[i : i + block]
            want.append(-sum(c / len(part) * math.log2(c / len(part)) for c in (part.count(x) for x in set(part))))
        assert np.allclose(K.block_entropy(data, block), want, atol=1e-12) and len(K.block_entropy(data, block)) == len(want)


def test_gram_table():
    for data in (b"", b"abc", b"abcabcabcabcabcd", seeded(400, 3), bytes(64)):
        for length in (0, 1, 4, 16):
            grams, counts, first = K.gram_table(data, length)
            windows = [data[i : i + length] for i in range(len(data) - length + 1)] if length > 0 else []
            assert {g: (c, f) for g, c, f in zip(map(bytes, grams), counts, first, strict=True)} == {w: (windows.count(w), windows.index(w)) for w in set(windows)}


@pytest.mark.parametrize("hashes", ["spread", "alike"])
def test_equal_windows(monkeypatch, hashes):
    if hashes == "alike":  # bytes decide where hashes agree
        monkeypatch.setattr(K, "word_hashes", lambda words: words[0] & K.U64(1 << 62))
    for data in (b"abc", b"abcabcabcabcabcd", seeded(400, 3) * 2, bytes(64), b"ab" * 200_000 + seeded(70, 1)):
        for length in (1, 5, 8, 13, 16, 64):
            words = K.window_words(data, length)
            want = {}
            for i in range(len(data) - length + 1):
                want.setdefault(data[i : i + length], []).append(i)
            assert list(map(bytes, K.word_bytes(words, length)[:50])) == [data[i : i + length] for i in range(len(words[0][:50]))]
            if want:
                order, starts = K.equal_windows(words)
                assert sorted(map(np.ndarray.tolist, np.split(order, starts[1:]))) == sorted(want.values())
            for most in (0, 3, len(want)):
                assert K.distinct_end(data, length, most) == (sorted(x[0] for x in want.values())[most] if most < len(want) else max(0, len(data) - length + 1))


def test_next_pow2():
    r = random.Random(1)
    for x in [0, 1, 2, 3, 2048, 2049, 1 << 30, 1 << 40] + [r.randrange(1 << 30) for _ in range(50)]:
        y = next_pow2(x)
        assert y == 1 << 30 or (y >= max(1, x) and y // 2 < max(1, x))
