"""The first 32 bits of MD5 of many short byte strings at once.

``hash_int`` of ``functions/exprs.py`` without a row per hash: where each of many keys is hashed once for each of many draws, a
task hashes arrays of keys (about a tenth of the CPU time). Both give the same numbers.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Strings hashed together: the arrays of a step stay in a core's cache.
CHUNK = 16_384
#: Bytes of one MD5 block beside its padding.
ONE_BLOCK = 55
_K = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURN = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_AT = [lambda i: i, lambda i: (5 * i + 1) % 16, lambda i: (3 * i + 5) % 16, lambda i: 7 * i % 16]


class Suffixes:
    """Byte strings, best CHUNK of them, whose hashes after any prefix are asked for: ``heads(prefix)``."""

    def __init__(self, strings: pa.Array):
        self.n = len(strings)
        self.length = np.asarray(pc.binary_length(strings).to_numpy(zero_copy_only=False), np.int64)
        self.strings = strings
        self.made: dict[int, tuple[list, list]] = {}

    def _words(self, at: int) -> tuple[list, list]:
        """The 16 words of each block but for a prefix of ``at`` bytes, constant words as numbers; and the strings too long for one block."""
        if at not in self.made:
            long = [i for i in np.flatnonzero(self.length + at > ONE_BLOCK)]
            block = np.zeros((self.n, 64), np.uint8)
            fits = np.where(self.length + at > ONE_BLOCK, 0, self.length)
            held = self.strings.cast(pa.large_binary())
            offsets = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + self.n + 1]
            data = np.frombuffer(held.buffers()[2] or b"", np.uint8)
            for j in range(int(fits.max(initial=0))):
                on = np.flatnonzero(fits > j)
                block[on, at + j] = data[offsets[on] + j]
            rows = np.arange(self.n)
            block[rows, np.where(fits == self.length, at + fits, 0)] = 0x80
            words = np.ascontiguousarray(block.view("<u4").T).astype(np.uint32)
            words[14] = (fits + at) * 8
            self.made[at] = [int(w[0]) if (w == w[0]).all() else w for w in words], long
        return self.made[at]

    def heads(self, prefix: bytes) -> np.ndarray:
        """The first eight hexadecimal digits of MD5(prefix + string) of each string, as uint32."""
        if not self.n:
            return np.zeros(0, np.uint32)
        if len(prefix) > ONE_BLOCK:
            return np.array([_head(prefix + s.as_py()) for s in self.strings], np.uint32)
        words, long = self._words(len(prefix))
        words = list(words)
        padded = np.frombuffer(prefix + bytes(-len(prefix) % 4), "<u4")
        for i, p in enumerate(padded):
            words[i] = words[i] | int(p) if isinstance(words[i], int) else words[i] | np.uint32(p)
        out = _first_word(words, self.n)
        for i in long:
            out[i] = _head(prefix + self.strings[int(i)].as_py())
        return out


def _head(message: bytes) -> int:
    return int.from_bytes(hashlib.md5(message).digest()[:4], "big")


def _first_word(words: list, n: int) -> np.ndarray:
    """Of each block's digest the first four bytes. Of the 64 steps, the last three don't reach them."""
    a, b, c, d = (np.full(n, v, np.uint32) for v in _START)
    f, g = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(61):
        quarter = i // 16
        if quarter == 0:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif quarter == 1:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif quarter == 2:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        word = words[_AT[quarter](i)]
        np.add(f, a, out=f)
        if isinstance(word, int):
            np.add(f, np.uint32((word + _K[i]) & 0xFFFFFFFF), out=f)
        else:
            np.add(f, word, out=f)
            np.add(f, np.uint32(_K[i]), out=f)
        turn = _TURN[quarter][i % 4]
        np.left_shift(f, np.uint32(turn), out=g)
        np.right_shift(f, np.uint32(32 - turn), out=f)
        np.bitwise_or(f, g, out=f)
        np.add(f, b, out=a)
        a, b, c, d = d, a, b, c
    return (b + np.uint32(_START[0])).byteswap()
