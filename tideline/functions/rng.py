"""Seeded streams: xoshiro128++ whose state is the SHA-256 of "seed/name". Equal seed and name give equal draws anywhere."""

from __future__ import annotations

import hashlib
import math
import struct

IDENTITY = {"algorithm": "xoshiro128++", "version": 1, "derivation": "sha256(seed/name), first 16 bytes, little-endian words", "vectors": "NumPy PCG64 seeded with the stream's four words"}
_MASK = 0xFFFFFFFF


def _turn(x: int, k: int) -> int:
    return (x << k | x >> (32 - k)) & _MASK


class Stream:
    """One named stream. Its state is four words and the spare normal, NaN for none."""

    def __init__(self, seed: int, name: str = ""):
        words = struct.unpack("<4I", hashlib.sha256(f"{seed}/{name}".encode()).digest()[:16])
        self.words, self.spare = list(words if any(words) else (1, 2, 3, 4)), math.nan

    def next_uint32(self) -> int:
        a, b, c, d = self.words
        out = (_turn((a + d) & _MASK, 7) + a) & _MASK
        t = b << 9 & _MASK
        c ^= a
        d ^= b
        self.words = [a ^ d, b ^ c, c ^ t, _turn(d, 11)]
        return out

    def next_float(self) -> float:
        return self.next_uint32() / 4294967296

    def normal(self) -> float:
        """Box-Muller; every second draw is the spare of the one before."""
        if not math.isnan(self.spare):
            out, self.spare = self.spare, math.nan
            return out
        u = 1 - self.next_float()
        r, turn = math.sqrt(-2 * math.log(u)), 2 * math.pi * self.next_float()
        self.spare = r * math.sin(turn)
        return r * math.cos(turn)

    def gaussian(self, mean: float, sd: float) -> float:
        return mean + sd * self.normal()

    def uniform(self, a: float, b: float) -> float:
        return a + (b - a) * self.next_float()

    def exponential(self, rate: float) -> float:
        return -math.log(1 - self.next_float()) / rate

    def save(self) -> list[float]:
        return [*map(float, self.words), self.spare]

    @classmethod
    def restore(cls, state: list[float]) -> Stream:
        out = cls.__new__(cls)
        out.words, out.spare = [int(w) for w in state[:4]], state[4]
        return out

    def generator(self):
        """A NumPy generator seeded by this stream, for long vectors."""
        import numpy as np

        return np.random.Generator(np.random.PCG64(self.words))
