"""Hashed character n-grams of many words at once, and sums of per-n-gram weights over texts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _finish(x: np.ndarray) -> np.ndarray:
    """The public splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(words: Sequence[str], sizes: Sequence[int], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each n-gram, where each word's n-grams end); words get < and > as their ends.

    Every word has at least one n-gram: the word itself is one, of whatever length.
    """
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    marked = [f"<{w}>" for w in words]
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    starts = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(points)) - starts[owner]
    left = lengths[owner] - place
    whole = np.add.reduceat(_finish(points * _FACTOR + place.astype(np.uint64)), starts)
    hashes, owners = [_finish(whole)], [np.arange(len(words))]
    for n in sizes:
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), np.uint64(n))
        for k in range(n):
            h = (h ^ points[at + k]) * _FACTOR
            h ^= h >> np.uint64(29)
        hashes.append(_finish(h)), owners.append(owner[at])
    of = np.concatenate(owners)
    order = np.argsort(of, kind="stable")
    bucket = (np.concatenate(hashes)[order] % np.uint64(buckets)).astype(np.int64)
    return bucket, np.cumsum(np.bincount(of, minlength=len(words)))


def segment_sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of rows; runs may be empty."""
    zero = np.zeros((1, *values.shape[1:]), np.float64)
    total = np.concatenate([zero, np.cumsum(values, axis=0, dtype=np.float64)])
    return total[ends] - total[np.concatenate([[0], ends[:-1]]).astype(np.int64)] if len(ends) else total[:0]


def index_words(texts: Sequence[list[str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, number of each occurrence's word, where each text's occurrences end)."""
    number: dict[str, int] = {}
    put = number.setdefault
    which = np.fromiter((put(w, len(number)) for t in texts for w in t), np.int64)
    return list(number), which, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))


def pick(rows, identifier: str, folds: int, fold: int, n: int):
    """``n`` identifiers of the learning folds, the first in a fixed random order."""
    from pyspark.sql import functions as F

    from lexitag.llm.common import crc_text

    learn = rows.select(identifier).filter(F.pmod(crc_text(F.col(identifier)), F.lit(folds)) != fold)
    return learn.distinct().orderBy(F.md5(F.col(identifier).cast("string")), identifier).limit(n)
