"""MD5 of many short texts at once, in numpy."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

#: Texts that one step holds: its arrays stay in a core's cache.
_BLOCK = 1 << 13
_SINES = [int(abs(math.sin(k + 1)) * 2**32) & 0xFFFFFFFF for k in range(64)]
_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_WORDS = [k if k < 16 else (5 * k + 1) % 16 if k < 32 else (3 * k + 5) % 16 if k < 48 else 7 * k % 16 for k in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_TENS = np.array([10**k for k in range(1, 20)], np.uint64)


def _digest(words: dict[int, np.ndarray | int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first two words of the digests of ``n`` messages of one block, whose words are arrays or one number for all; others are 0."""
    a, b, c, d = (np.full(n, v, np.uint32) for v in _START)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for k in range(64):
        if k < 16:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif k < 32:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif k < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        word = words.get(_WORDS[k], 0)
        if isinstance(word, np.ndarray):
            np.add(f, word, out=f)
            word = 0
        np.add(f, np.uint32((_SINES[k] + word) & 0xFFFFFFFF), out=f)
        np.left_shift(f, np.uint32(_TURNS[k]), out=t)
        np.right_shift(f, np.uint32(32 - _TURNS[k]), out=f)
        np.bitwise_or(f, t, out=f)
        np.add(f, b, out=a)
        a, b, c, d = d, a, b, c
    return a + np.uint32(_START[0]), b + np.uint32(_START[1])


def _hashed(head: bytes, numbers: np.ndarray, digits: int) -> np.ndarray:
    """As :func:`first_bits`, of a block of numbers of as many digits."""
    size = len(head) + digits
    if size > 55:
        raise ValueError("texts must fit into one block")
    fixed = head + b"0" * digits + b"\x80"
    fixed = np.frombuffer(fixed.ljust(56, b"\0") + (8 * size).to_bytes(8, "little"), "<u4")
    words: dict[int, np.ndarray | int] = {k: int(w) for k, w in enumerate(fixed) if w}
    rest = numbers.astype(np.uint32 if digits < 10 else np.uint64)
    ten = rest.dtype.type(10)
    for at in range(size - 1, len(head) - 1, -1):
        next_rest = rest // ten
        digit = (rest - next_rest * ten).astype(np.uint32, copy=False)
        words[at // 4] = (digit << np.uint32(8 * (at % 4))) + (words[at // 4] if isinstance(words[at // 4], np.ndarray) else np.uint32(words[at // 4]))
        rest = next_rest
    a, b = _digest(words, len(numbers))
    return (a.byteswap().astype(np.uint64) << np.uint64(28)) | (b.byteswap() >> np.uint32(4)).astype(np.uint64)


def first_bits(head: str, numbers: np.ndarray) -> np.ndarray:
    """The first 60 bits of the MD5 of ``head`` and each whole number in decimals, as a number."""
    start, out = head.encode(), np.empty(len(numbers), np.uint64)
    for k in range(0, len(numbers), _BLOCK):
        part, into = np.asarray(numbers[k : k + _BLOCK], np.int64), out[k : k + _BLOCK]
        below = part < 0
        size = np.where(below, -part, part).view(np.uint64)
        kind = np.searchsorted(_TENS, size, "right") + 1 + 32 * below
        first = kind[0]
        if (kind == first).all():
            into[:] = _hashed(start + b"-" * bool(first > 32), size, int(first % 32))
            continue
        for one in np.unique(kind):
            same = kind == one
            into[same] = _hashed(start + b"-" * bool(one > 32), size[same], int(one % 32))
    return out


def spans(first: int, last: int, size: int = 1 << 16) -> Iterator[np.ndarray]:
    """The whole numbers from ``first`` up to and without ``last``, in arrays."""
    for k in range(first, last, size):
        yield np.arange(k, min(k + size, last), dtype=np.int64)
