"""Language by hierarchical discrimination: family first, then one-versus-one linear SVMs within it.

Texts are bags of hashed character n-grams (with word ends), as frequencies. One linear support
vector machine per language family, against all others, chooses the family; within a family with
several languages, one machine per pair of languages votes, the sum of margins deciding ties. All are
trained in numpy on pieces of a bounded sample: at most ``SAMPLE_DOCS`` documents a language, in a
fixed random order, up to ``SAMPLE_PIECES`` pieces of ``PIECE`` words. As they are linear, a word's
contribution is worked out once per batch, and every whole text is scored.

Languages that FAMILIES does not list form a family of their own.

Defined cases: a text that is null or has no letter is ``und`` with score 0; null languages and
identifiers are not learned from; with one learned language every other text is that language,
with score 1; with none every text is ``und``; repeated rows are predicted each; no documents give
no rows; other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitag.llm.common import crc_text, quoted, text_batches
from lexitag.llm.subwords import grams, index_words, pick, segment_sums

FOLDS, HELD_OUT = 3, 1
SAMPLE_DOCS = 400
SAMPLE_PIECES = 500
PIECE = 25
SIZES = (1, 2, 3)
BUCKETS = 1 << 13
STEPS, RATE, DECAY, SCALE = 150, 0.5, 1e-5, 20.0
#: Families of languages by ISO 639-1 code (fixed values).
FAMILIES = {
    "germanic": "af da de en fy is lb nl nn no nb sv yi".split(),
    "romance": "ca es fr gl it la oc pt ro".split(),
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk".split(),
    "baltic": "lt lv".split(),
    "celtic": "br cy ga gd".split(),
    "uralic": "et fi hu".split(),
    "turkic": "az kk ky tr tt uz".split(),
    "semitic": "am ar he mt".split(),
    "indo-aryan": "bn gu hi mr ne pa si ur".split(),
    "dravidian": "kn ml ta te".split(),
    "malayo-polynesian": "id jv mg ms tl".split(),
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}


def family(language: str) -> str:
    return _FAMILY.get(language.lower().replace("_", "-").split("-")[0], f"={language}")


def _words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def _svm(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and bias of a linear machine: averaged subgradient steps, classes weighing the same."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = np.zeros(x.shape[1], np.float32)
    total = np.zeros_like(w)
    for step in range(STEPS):
        push = np.where(y * (x @ w) < 1, y * weight, 0).astype(np.float32)
        w = w * (1 - RATE * DECAY) + RATE * 50 / (1 + step / 30) * (push @ x) / (1e-6 + np.abs(push).sum() + 0.05)
        if step >= STEPS // 2:
            total += w
    return total / (STEPS - STEPS // 2)


@dataclass
class Model:
    """Machines as columns of ``weights`` (n-gram buckets by machines) with a bias each."""

    languages: list[str]
    families: list[str]
    pairs: list[tuple[str, str]]
    weights: np.ndarray
    bias: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        words, which, ends = index_words([_words(t) for t in texts])
        bucket, word_ends = grams(words, SIZES, BUCKETS)
        sizes = np.diff(word_ends, prepend=0)
        per_word = np.concatenate([segment_sums(self.weights[bucket], word_ends), sizes[:, None]], axis=1)
        total = segment_sums(per_word[which], ends)
        margins = SCALE * total[:, :-1] / np.maximum(total[:, -1:], 1) + self.bias
        names, scores = [], []
        for text, m in zip(texts, margins):
            if not text or not any(map(str.isalpha, text)):
                names.append("und"), scores.append(0.0)
                continue
            name, score = self._choose(m)
            names.append(name), scores.append(score)
        return names, scores

    def _choose(self, m: np.ndarray) -> tuple[str, float]:
        n = len(self.families)
        chosen = self.families[int(np.argmax(m[:n]))] if n > 1 else self.families[0]
        within = [x for x in self.languages if family(x) == chosen]
        sure = 1 / (1 + np.exp(-2 * np.clip(m[:n].max(), -20, 20))) if n > 1 else 1.0
        if len(within) == 1:
            return within[0], float(sure)
        votes = {x: [0, 0.0] for x in within}
        for (a, b), margin in zip(self.pairs, m[n:]):
            if a in votes and b in votes:
                votes[a if margin > 0 else b][0] += 1
                votes[a][1] += margin
                votes[b][1] -= margin
        best = max(within, key=lambda x: votes[x])
        mean = votes[best][1] / (len(within) - 1)
        return best, float(sure / (1 + np.exp(-2 * np.clip(mean, -20, 20))))


def fit(texts: list[str], languages: list[str]) -> Model:
    """Train all machines on pieces of the texts."""
    pieces, labels = [], []
    held: dict[str, int] = {}
    for text, language in zip(texts, languages):
        words = _words(text)
        for at in range(0, len(words), PIECE):
            if held.get(language, 0) < SAMPLE_PIECES and any(map(str.isalpha, "".join(words[at : at + PIECE]))):
                pieces.append(words[at : at + PIECE]), labels.append(language)
                held[language] = held.get(language, 0) + 1
    names = sorted(held)
    families = sorted({family(x) for x in names})
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if family(a) == family(b)]
    words, which, ends = index_words(pieces)
    bucket, word_ends = grams(words, SIZES, BUCKETS)
    starts = np.concatenate([[0], word_ends[:-1]]).astype(np.int64) if len(words) else word_ends
    x = np.zeros((len(pieces), BUCKETS + 1), np.float32)
    for i, (a, b) in enumerate(zip([0, *ends[:-1]], ends)):
        seen = np.concatenate([bucket[starts[w] : word_ends[w]] for w in which[a:b]])
        np.add.at(x[i], seen, np.float32(SCALE / len(seen)))
    x[:, -1] = 1
    labels = np.array(labels, dtype=object)
    of = np.array([family(v) for v in labels], dtype=object)
    machines = [_svm(x, np.where(of == f, 1, -1)) for f in families] if len(families) > 1 else [np.zeros(BUCKETS + 1)]
    for a, b in pairs if names else []:
        rows = (labels == a) | (labels == b)
        machines.append(_svm(x[rows], np.where(labels[rows] == a, 1, -1)))
    stacked = np.array(machines, np.float32).T if names else np.zeros((BUCKETS + 1, 0), np.float32)
    return Model(names, families, pairs, np.ascontiguousarray(stacked[:-1]), stacked[-1])


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> Model:
    """Fit on the bounded sample. Identifiers are picked first, so texts are read once and not shuffled."""
    rows = docs.select(quoted(id_col).alias("id"), quoted(lang_col).cast("string").alias("lang")).dropna()
    names = sorted(r["lang"] for r in rows.select("lang").distinct().collect())  # a row per language
    picks = [pick(rows.filter(F.col("lang") == name), "id", FOLDS, HELD_OUT, SAMPLE_DOCS) for name in names]
    if not picks:
        return fit([], [])
    found = docs.select(
        quoted(id_col).alias("id"), quoted(lang_col).cast("string").alias("lang"), quoted(text_col).alias("text")
    ).join(F.broadcast(reduce(DataFrame.union, picks)), "id")
    sample = found.dropna().orderBy(F.md5(F.col("id").cast("string")), "id").limit(SAMPLE_DOCS * len(names)).collect()
    return fit([r["text"] for r in sample], [r["lang"] for r in sample])


def predict(docs: DataFrame, model: Model, id_col: str, text_col: str) -> DataFrame:
    """(id, held_out, lang_pred, score) of every document, one row per input row."""
    text_batches(docs.sparkSession)
    identifier = quoted(id_col)
    rows = docs.select(
        identifier.alias("id"),
        (F.pmod(crc_text(identifier), F.lit(FOLDS)) == HELD_OUT).alias("held_out"),
        quoted(text_col).cast("string").alias("text"),
    )
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = shared.value.predict(batch.column("text").to_pylist())
            columns = [*batch.columns[:2], pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "held_out", "lang_pred", "score"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, held_out boolean, lang_pred string, score double")
