"""The first 32 bits of md5 digests of many short texts at once, as numpy blocks."""

from __future__ import annotations

import math

import numpy as np

_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
_PLACES = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else (7 * i) % 16 for i in range(64)]
#: Texts of one block: its words stay in a core's cache.
BLOCK = 2048


def first_words(prefix: bytes, rest: np.ndarray) -> np.ndarray:
    """The first 8 hexadecimal digits, as numbers, of md5(prefix + each of rest); rest holds bytes of a fixed width without zeros,
    and a text has 55 bytes at most."""
    out = np.empty(len(rest), np.uint32)
    width = rest.dtype.itemsize
    if len(prefix) + width > 55:
        raise ValueError("texts of more than one block")
    text = np.ascontiguousarray(rest).view(np.uint8).reshape(len(rest), width)
    lengths = len(prefix) + np.char.str_len(rest)
    for n in range(0, len(rest), BLOCK):
        out[n : n + BLOCK] = _block(prefix, text[n : n + BLOCK], lengths[n : n + BLOCK])
    return out


def _block(prefix: bytes, text: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    size = len(text)
    message = np.zeros((size, 64), np.uint8)
    message[:, : len(prefix)] = np.frombuffer(prefix, np.uint8)
    message[:, len(prefix) : len(prefix) + text.shape[1]] = text
    message[np.arange(size), lengths] = 0x80
    words = np.ascontiguousarray(message.view("<u4").T)
    words[14] = 8 * lengths
    used = [bool(w.any()) for w in words]
    a, b, c, d = (np.full(size, x) for x in _START)
    f, high = np.empty(size, np.uint32), np.empty(size, np.uint32)
    for i in range(61):  # the first word is not changed after
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.bitwise_not(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        a += f
        a += _SINES[i]
        if used[_PLACES[i]]:
            a += words[_PLACES[i]]
        np.left_shift(a, np.uint32(_TURNS[i]), out=high)
        np.right_shift(a, np.uint32(32 - _TURNS[i]), out=a)
        a |= high
        a += b
        a, b, c, d = d, a, b, c
    # after step 60 the new word stands in b; it is the first one of the state that the last steps only hand round
    return (b + _START[0]).byteswap()
