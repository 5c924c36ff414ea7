"""The Merkle manifest against a plain version that hashes whole lists."""

import zlib

import pytest

from lexitag.llm import merkle
from lexitag.llm.queries import QUERIES
from tests.llm import brute
from tests.llm.test_operators import SMALL, _sql

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
RESULT = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def _leaf(row):
    texts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row]
    return brute.sha("".join(texts).encode())


def _levels(nodes, run):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([brute.sha("".join(last[i : i + run]).encode()) for i in range(0, len(last), run)])
    return levels


def _siblings(levels, at, run):
    found = []
    for level in levels[:-1]:
        first = at // run * run
        found.append(("".join(level[first:at]), "".join(level[at + 1 : first + run])))
        at //= run
    return found


def _tampered(row):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4]) if row[4] is not None else None
    return (*row[:4], lower)


def _wanted(rows, run=merkle.RUN):
    groups = {}
    for row in rows:
        groups.setdefault((row[1] is not None, row[1] or ""), []).append((row[0] is not None, row[0] or 0, _leaf(row), row))
    order = sorted(groups, key=lambda g: (g[0], g[1].encode()))
    members = {g: sorted(groups[g], key=lambda m: m[:3]) for g in order}
    trees = {g: _levels([m[2] for m in members[g]], run) for g in order}
    top = _levels([trees[g][-1][0] for g in order], run)
    out = []
    for i, g in enumerate(order):
        for at, (known, doc_id, leaf, row) in enumerate(members[g]):
            path = _siblings(trees[g], at, run) + _siblings(top, i, run)
            hit = known and zlib.crc32(str(doc_id).encode()) % 5 == 0
            node = _leaf(_tampered(row)) if hit else leaf
            for left, right in path:
                node = brute.sha((left + node + right).encode())
            proof = brute.sha("".join(left + right for left, right in path).encode())
            out.append((row[0], leaf, trees[g][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return out


@pytest.mark.parametrize("which", ["small", "messy", "empty"])
def test_op11_merkle(spark, which, messy, empty, rows, same):
    folder = {"small": SMALL, "messy": messy, "empty": empty}[which]
    df = QUERIES["op11_merkle"](spark, folder)
    wanted = _wanted(rows(folder, "documents", *COLUMNS))
    same(df, RESULT, wanted)
    if wanted:
        assert {r[6] for r in wanted} == {True, False}
    columns, found = _sql(folder, "op11_merkle")
    same(df, columns, found)


def _table(spark, sizes):
    data = [(n * 1000 + i, f"g{n}", "en", None, f"Text {n} {i}") for n, size in enumerate(sizes) for i in range(size)]
    return data, spark.createDataFrame(data, "doc_id long, source string, lang string, n_chars long, text string")


@pytest.mark.parametrize("sizes", [[1], [2], [3, 1, 4, 5], [70, 1, 17], [1] * 40])
def test_trees_of_many_rounds(spark, monkeypatch, same, sizes):
    monkeypatch.setattr(merkle, "RUN", 2)
    monkeypatch.setattr(merkle, "BLOCK", 4)
    data, df = _table(spark, sizes)
    got = merkle.report(df, COLUMNS, "doc_id", "source", "text").withColumnRenamed("id", "doc_id")
    same(got, RESULT, _wanted(data, 2))


def test_group_of_several_blocks(spark, same):
    data, df = _table(spark, [600, 256, 257, 16])
    got = merkle.report(df.repartition(5), COLUMNS, "doc_id", "source", "text").withColumnRenamed("id", "doc_id")
    same(got, RESULT, _wanted(data))


def test_any_change_breaks_the_proof(spark):
    data, df = _table(spark, [40, 3])
    changed = merkle.leaf([merkle.quoted(c) if c != "lang" else merkle.F.lit("de") for c in COLUMNS])
    proofs = merkle.manifest(df, COLUMNS, "doc_id", "source", {"changed": changed}).proofs()
    states = proofs.select(
        (merkle.folded(merkle.F.col("leaf"), merkle.F.col("path")) == merkle.F.col("root")).alias("own"),
        (merkle.folded(merkle.F.col("changed"), merkle.F.col("path")) == merkle.F.col("root")).alias("other"),
    )
    assert {tuple(r) for r in states.collect()} == {(True, False)} and proofs.count() == len(data)
