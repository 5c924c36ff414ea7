"""Collocations against plain counting, and the quotient filters by themselves."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from lexitag.llm import collocations, quotient
from lexitag.llm.queries import QUERIES
from tests.llm.test_operators import SMALL, _sql

RESULT = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _wanted(rows, least=100, longest=5, first=2000):
    f, n = {}, Counter()
    for text, lang in rows:
        counted = f.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n["und" if lang is None else lang] += len(words)
            counted.update(tuple(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    out = []
    for lang, counted in f.items():
        found = {p: a for p, a in counted.items() if len(p) > 1 and a >= least}
        covered = {}
        for p, a in found.items():
            for q in (p[i:j] for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p)):
                covered[q] = max(covered.get(q, 0), a)
        rows = []
        for p, a in found.items():
            if covered.get(p, 0) < a:
                cuts = [(1000 * a * n[lang] // (counted[p[:k]] * counted[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                rows.append((-score, -a, " ".join(p).encode(), counted[p[:k]], counted[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return out


@pytest.mark.parametrize("which", ["small", "messy", "empty"])
def test_op13_collocations(spark, which, messy, empty, rows, same):
    folder = {"small": SMALL, "messy": messy, "empty": empty}[which]
    df = QUERIES["op13_collocations"](spark, folder)
    wanted = _wanted(rows(folder, "documents", "text", "lang"))
    assert wanted or which != "small"
    same(df, RESULT, wanted)
    columns, found = _sql(folder, "op13_collocations")
    same(df, columns, found)


def test_rarer_phrases_of_a_messy_table(spark, messy, rows, same):
    got = collocations.phrases(spark.read.parquet(f"{messy}/documents.parquet"), "text", "lang", least=4, first=50)
    wanted = _wanted(rows(messy, "documents", "text", "lang"), 4, 5, 50)
    assert len(wanted) > 50
    same(got, RESULT, wanted)


def _planted():
    rng = random.Random(13)
    words = [f"w{i}" for i in range(60)] + ["Über", "é", "ÀB", "東京"]
    phrases = ["new york city hall", "a a a a a a", "x y", "Q\tr  s T u v"]
    texts = []
    for _ in range(160):
        parts = [rng.choice(phrases) if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randrange(60))]
        texts.append("".join(p + rng.choice([" ", " ", " ", "\t", ", ", ".", "\n", "\x0b"]) for p in parts))
    rows = [(t, rng.choice(["en", "en", "de", None, "und"])) for t in texts]
    return rows + rows[:9] + [(None, "en"), ("", None), (" ".join(rng.choice(words) for _ in range(5000)), "en")]


@pytest.mark.parametrize("way", ["plain", "small parts", "shuffled words"])
def test_planted_phrases(spark, monkeypatch, same, way):
    if way == "small parts":  # many rows of runs, filters and merges, and a bitmap that tells little
        for name, value in {"RUN_ROW": 50, "GRAMS": 70, "SLOT_BITS": 9, "BLOCK_BITS": (3, 3)}.items():
            monkeypatch.setattr(collocations, name, value)
    if way == "shuffled words":
        monkeypatch.setattr(collocations, "fits_broadcast", lambda df: False)
    rows = _planted()
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    got = collocations.phrases(df, "text", "lang", least=8, first=40)
    same(got, RESULT, _wanted(rows, 8, 5, 40))


@pytest.mark.parametrize("widths", [[1, 1], [3, 5], [17, 17], [20, 20, 20], [26] * 5, [31] * 5, [64, 64], [7] * 5])
def test_keys_come_back(widths):
    rng = np.random.default_rng(sum(widths))
    digits = [rng.integers(0, 2**w, 500, np.uint64, endpoint=False) if w < 64 else rng.integers(0, 2**64, 500, np.uint64) for w in widths]
    keys = quotient.permuted(digits, widths)
    assert all((a == b).all() for a, b in zip(quotient.restored(keys, widths), digits))
    assert len(set(zip(*(k.tolist() for k in keys)))) == len(set(zip(*(d.tolist() for d in digits))))


@pytest.mark.parametrize("widths", [[1, 1], [9, 9], [17, 17], [26] * 5])
def test_filters_are_lossless(widths):
    rng = np.random.default_rng(7)
    width, counted, filters = sum(widths), Counter(), []
    for size in (1, 40, 3000):
        digits = [rng.integers(0, min(2**w, 12), size, np.uint64) for w in widths]
        counted.update(zip(*(d.tolist() for d in digits)))
        filters.append(quotient.Filter.of(quotient.permuted(digits, widths), width))
    filters += [filters[-1]] * 300  # counts beyond one byte
    for key, count in Counter(zip(*(d.tolist() for d in digits))).items():
        counted[key] += 300 * count
    bits = min(3, width)
    back = []
    for block, part in quotient.Filter.merged(filters).blocks(bits):
        again = quotient.Filter.decode(part.encode(bits), block, bits, width)
        assert all((a == b).all() for a, b in zip(again.keys, part.keys)) and (again.counts == part.counts).all()
        back.append(again)
    whole = quotient.Filter.merged(back)
    found = dict(zip(zip(*(d.tolist() for d in quotient.restored(whole.keys, widths))), whole.counts.tolist()))
    assert found == dict(counted)


def test_stored_counters_are_compact():
    rng = np.random.default_rng(9)
    keys = quotient.permuted([rng.integers(0, 1000, 20_000, np.uint64) for _ in range(2)], [10, 10])
    made = quotient.Filter.of(keys, 20)
    assert len(made.encode(0)) < 2.5 * len(made)


def test_a_task_of_many_words_needs_little_memory(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    class Frame:  # hands out the worker's function and the settings it is to run with
        def __init__(self):
            self.sparkSession = self.conf = self
            self.settings = {"spark.sql.execution.arrow.maxRecordsPerBatch": "10000"}
            self.get, self.select = self.settings.get, lambda *names: self

        def set(self, name, value):
            self.settings[name] = value

        def mapInArrow(self, run, schema):
            return run, int(self.settings["spark.sql.execution.arrow.maxRecordsPerBatch"])

    monkeypatch.setattr(collocations, "keep", lambda made: made)
    rng, whole = np.random.default_rng(2), np.full(1 << 24, 255, np.uint8)
    run, count = collocations._counted(Frame(), 5, 17, 10, type("Shared", (), {"value": whole}))

    def batches(rows=190):
        for at in range(0, rows, count):
            runs = rng.integers(1, 100_000, (min(count, rows - at), collocations.RUN_ROW))
            runs[:, ::12] = 0
            yield pa.RecordBatch.from_arrays([collocations._listed(list(runs))], ["runs"])

    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in run(batches()))
        assert tracemalloc.get_traced_memory()[1] < 230 << 20
    finally:
        tracemalloc.stop()
