"""Whole-text word splitting and hashing with numpy, shared by the word-level operators.

A word is a maximal run of bytes outside ``\\x20 \\x09-\\x0D``. Hashes are
polynomial over the bytes (mod 2**64) with a fixed random value per byte and
then mixed, so they depend on the word alone: any task, on any machine, gives
a word the same hash.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
BLOCK = 1 << 20          # bytes hashed at a time; bounds the memory of a long text
_GOLD = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class WordHasher:
    """``lanes`` independent 64-bit hashes of every word of a byte string."""

    def __init__(self, lanes: int = 1, seed: int = 20240229):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(1, 2**63, size=(lanes, 256), dtype=np.int64).astype(U64) | U64(1)
        self.space = np.zeros(256, dtype=bool)
        self.space[[0x20, 9, 10, 11, 12, 13]] = True
        self.table[:, self.space] = 0
        bases = [int(b) | 1 for b in rng.integers(2**61, 2**62, size=lanes)]
        self.power, self.inverse = [], []
        for b in bases:
            self.power.append(_powers(b, BLOCK + 1))
            self.inverse.append(_powers(pow(b, -1, 1 << 64), BLOCK + 1))

    def __call__(self, data: bytes) -> list[np.ndarray]:
        """One uint64 array per lane, a value per word in order."""
        out: list[list[np.ndarray]] = [[] for _ in self.table]
        at, n = 0, len(data)
        raw = np.frombuffer(data, dtype=np.uint8)
        while at < n:
            end = min(n, at + BLOCK)
            if end < n:      # cut at white space; a word longer than a block is hashed on its own
                gaps = np.flatnonzero(self.space[raw[at:end]])
                if len(gaps):
                    end = at + int(gaps[-1]) + 1
                else:
                    after = np.flatnonzero(self.space[raw[end:]]) if n - end <= BLOCK else None
                    stop = n if after is not None and not len(after) else (
                        end + int(after[0]) if after is not None else self._word_end(raw, end))
                    for lane, h in enumerate(self._long(raw[at:stop])):
                        out[lane].append(h)
                    at = stop
                    continue
            for lane, h in enumerate(self._block(raw[at:end])):
                out[lane].append(h)
            at = end
        return [np.concatenate(x) if x else np.empty(0, U64) for x in out]

    def _word_end(self, raw: np.ndarray, at: int) -> int:
        while at < len(raw):
            gaps = np.flatnonzero(self.space[raw[at:at + BLOCK]])
            if len(gaps):
                return at + int(gaps[0])
            at += BLOCK
        return len(raw)

    def spans(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gap = np.empty(len(raw) + 2, dtype=bool)
        gap[0] = gap[-1] = True
        gap[1:-1] = self.space[raw]
        turn = np.flatnonzero(gap[1:] != gap[:-1])
        return turn[::2], turn[1::2]

    def _block(self, raw: np.ndarray) -> list[np.ndarray]:
        begin, end = self.spans(raw)
        out = []
        for lane, table in enumerate(self.table):
            total = np.zeros(len(raw) + 1, dtype=U64)
            np.cumsum(table[raw] * self.power[lane][:len(raw)], out=total[1:])
            h = (total[end] - total[begin]) * self.inverse[lane][begin]
            out.append(mix(h + (end - begin).astype(U64) * _GOLD))
        return out

    def _long(self, raw: np.ndarray) -> list[np.ndarray]:
        """The hash of one word longer than a block, block by block."""
        out = []
        for lane, table in enumerate(self.table):
            base, total, shift = int(self.power[lane][1]), 0, 1
            for at in range(0, len(raw), BLOCK):
                part = raw[at:at + BLOCK]
                here = int((table[part] * self.power[lane][:len(part)]).sum(dtype=U64))
                total = (total + here * shift) % 2**64
                shift = shift * pow(base, len(part), 1 << 64) % 2**64
            h = np.array([total], dtype=U64) + np.array([len(raw)], dtype=U64) * _GOLD
            out.append(mix(h))
        return out


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=U64)
    out[0] = 1
    have = 1
    while have < n:          # doubling: p[have + i] = p[i] * base**have
        more = min(have, n - have)
        out[have:have + more] = out[:more] * U64(pow(base, have, 1 << 64))
        have += more
    return out


def window_hashes(words: np.ndarray, width: int, base: int) -> np.ndarray:
    """A 64-bit hash of each ``width`` consecutive words (empty if there are fewer)."""
    if len(words) < width:
        return np.empty(0, dtype=U64)
    out = np.zeros(len(words) - width + 1, dtype=U64)
    for j in range(width):
        out *= U64(base)
        out += words[j:j + len(out)]
    return mix(out)
