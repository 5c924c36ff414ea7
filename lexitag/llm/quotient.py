"""Counting quotient filters in numpy: exact, compact counters of wide whole numbers.

A key of ``width`` bits is a row of digits of at most 64 bits, the first one the highest. Keys are
permuted by a keyed network of rounds that can be undone, so equal slices of their range hold equal
shares whatever was counted. A filter is the sorted permuted keys with their counts. Stored, a key is
its quotient, said by two bits in bitmaps (is the quotient occupied, does its run end here), and its
whole remainder, so nothing is lost: the keys come back by undoing the permutation.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence

import numpy as np

ROUNDS = 3
Digits = list[np.ndarray]


def regroup(digits: Digits, widths: Sequence[int], wanted: Sequence[int]) -> Digits:
    """The same bits as digits of other widths; both lists of widths have the same sum."""
    size = len(digits[0])
    ends, stops = np.cumsum(widths), np.cumsum(wanted)
    out = []
    for b, wide in zip(stops, wanted):
        a, got = b - wide, np.zeros(size, np.uint64)
        for digit, d, width in zip(digits, ends, widths):
            low, high = max(a, d - width), min(b, d)
            if low < high:
                bits = digit >> np.uint64(d - high)
                if high - low < 64:
                    bits = bits & np.uint64((1 << int(high - low)) - 1)
                got |= bits << np.uint64(b - high)
        out.append(got)
    return out


def key_widths(width: int) -> list[int]:
    """Digits that a key is sorted by: as few as can be."""
    count = max(1, -(-width // 64))
    return [width - 64 * (count - 1)] + [64] * (count - 1)


def _limb_widths(width: int) -> list[int]:
    """Two or more digits of nearly the same width, which the rounds mix."""
    count = max(2, -(-width // 64))
    return [(width + i) // count for i in range(count)]


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    """The public splitmix64 finaliser of ``x`` and a round's key."""
    x = x ^ np.uint64(key * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rounds(limbs: Digits, widths: Sequence[int], order: Sequence[int]) -> Digits:
    limbs = list(limbs)
    for step in order:
        i = step % len(limbs)
        mask = np.uint64((1 << widths[i]) - 1)
        limbs[i] = limbs[i] ^ (_mixed(limbs[i - 1], step + 1) & mask)
    return limbs


def permuted(digits: Digits, widths: Sequence[int]) -> Digits:
    """Sort digits (``key_widths``) of the permuted keys."""
    width = sum(widths)
    inner = _limb_widths(width)
    limbs = _rounds(regroup(digits, widths, inner), inner, range(ROUNDS * len(inner)))
    return regroup(limbs, inner, key_widths(width))


def restored(keys: Digits, widths: Sequence[int]) -> Digits:
    """What was permuted, in digits of these widths."""
    width = sum(widths)
    inner = _limb_widths(width)
    limbs = regroup(keys, key_widths(width), inner)
    return regroup(_rounds(limbs, inner, range(ROUNDS * len(inner) - 1, -1, -1)), inner, widths)


def top(keys: Digits, width: int, bits: int) -> np.ndarray:
    """The highest ``bits`` bits of permuted keys."""
    return regroup(keys, key_widths(width), [bits, *key_widths(width - bits)] if width > bits else [bits])[0]


class Filter:
    """Sorted permuted keys and how often each was counted."""

    def __init__(self, keys: Digits, counts: np.ndarray, width: int):
        self.keys, self.counts, self.width = keys, counts, width

    def __len__(self) -> int:
        return len(self.counts)

    @classmethod
    def of(cls, keys: Digits, width: int, counts: np.ndarray | None = None) -> Filter:
        """Keys in any order, repeated ones summed up."""
        if not len(keys[0]):
            return cls(keys, np.zeros(0, np.int64), width)
        if counts is None and len(keys) == 1:
            ordered, counts = [np.sort(keys[0])], None
        else:
            order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
            ordered, counts = [k[order] for k in keys], None if counts is None else counts[order]
        fresh = np.ones(len(ordered[0]), bool)
        fresh[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in ordered])
        at = np.flatnonzero(fresh)
        sums = np.diff(np.append(at, len(fresh))) if counts is None else np.add.reduceat(counts, at)
        return cls([k[at] for k in ordered], sums.astype(np.int64), width)

    @classmethod
    def merged(cls, filters: Sequence[Filter]) -> Filter:
        if len(filters) == 1:
            return filters[0]
        keys = [np.concatenate(k) for k in zip(*(f.keys for f in filters))]
        return cls.of(keys, filters[0].width, np.concatenate([f.counts for f in filters]))

    def blocks(self, bits: int):
        """(block, filter) for every slice of the range by its highest bits that holds keys."""
        block = top(self.keys, self.width, bits)
        starts = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else []
        for a, b in zip(starts, [*starts[1:], len(block)]):
            yield int(block[a]), Filter([k[a:b] for k in self.keys], self.counts[a:b], self.width)

    def encode(self, bits: int) -> bytes:
        """The stored form of one block of ``blocks(bits)``, which the reader knows the number of."""
        n, rest = len(self), self.width - bits
        slots = min(rest, max(0, n.bit_length() - 1))
        _, quotient, *remainder = regroup(self.keys, key_widths(self.width), [bits, slots, *_remainder(rest - slots)])
        occupied = np.zeros(1 << slots, bool)
        occupied[quotient.astype(np.int64)] = True
        ends = np.append(quotient[1:] != quotient[:-1], True)
        parts = [struct.pack("<IB", n, slots), np.packbits(occupied).tobytes(), np.packbits(ends).tobytes()]
        for digit, width in zip(remainder, _remainder(rest - slots)):
            parts.append(digit.astype("<u8").view(np.uint8).reshape(n, 8)[:, : -(-width // 8)].tobytes())
        parts += [np.minimum(self.counts, 255).astype(np.uint8).tobytes(), self.counts[self.counts >= 255].astype("<i8").tobytes()]
        return b"".join(parts)

    @classmethod
    def decode(cls, blob: bytes, block: int, bits: int, width: int) -> Filter:
        n, slots = struct.unpack_from("<IB", blob)
        at, rest = 5, width - bits

        def take(size: int) -> np.ndarray:
            nonlocal at
            at += size
            return np.frombuffer(blob, np.uint8, size, at - size)

        occupied = np.flatnonzero(np.unpackbits(take(-(-(1 << slots) // 8)), count=1 << slots))
        ends = np.unpackbits(take(-(-n // 8)), count=n).astype(np.int64)
        quotient = occupied[np.cumsum(ends) - ends].astype(np.uint64)
        digits, widths = [np.full(n, block, np.uint64), quotient], [bits, slots]
        for w in _remainder(rest - slots):
            size = -(-w // 8)
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :size] = take(n * size).reshape(n, size)
            digits.append(wide.reshape(-1).view("<u8").astype(np.uint64))
            widths.append(w)
        counts = take(n).astype(np.int64)
        counts[counts == 255] = np.frombuffer(blob, "<i8", -1, at)
        return cls(regroup(digits, widths, key_widths(width)), counts, width)


def _remainder(width: int) -> list[int]:
    return key_widths(width) if width else []
