"""SimHash near-duplicates: 64-bit fingerprints, BK-trees per shard, connected components.

Fingerprints are made per text (numpy in Arrow batches), then each distinct one is handled once,
however many copies it has. Fingerprints that differ in at most 3 of 64 bits agree in at least two of
five bands, so every pair of them meets in one of ten shards, named by two bands and their values. A
shard's fingerprints become a BK-tree, whose children are keyed by their integer distance to the
parent; a search follows only edges within the radius of its own distance. What a shard returns is
not its pairs but a forest that joins what it links, at most one edge per fingerprint.

Shards with more than ``PIECE`` fingerprints are cut into pieces by a hash; then each piece is a tree
that is sent ("broadcast") to itself and, with the members as queries, to every other piece of the
shard, so no task holds more than two pieces. No link is lost, as all pairs of pieces meet.

Components are found by minimum labels with pointer jumping over the edges, as joins and aggregates
on written tables; only counts come to the driver.

Defined cases: a null text has no words, like an empty one; such texts have fingerprint 0 and are
linked like any other; a text of fewer words than a shingle is one shingle; null identifiers are not
taken as a component's name (null if it has no other); repeated rows are members each; no
documents give no rows; other columns of the input, whatever their names, are not read, and handed on
by ``keep_first``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitag.llm.common import enclose, group_key, inner, quoted, reopen, text_batches
from lexitag.operators.lasting import keep

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Bits of the five bands (they add up to 64); two of five agree wherever at most three bits differ.
BANDS = (13, 13, 13, 13, 12)
PIECE = 1024
BITS = 64


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The XXH64 of every shingle of one text, in order; none for a text without words."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    spans = zip(starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, n)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of one text: bits set in more than half of its shingles' XXH64."""
    hashes = shingle_hashes(text, shingle)
    n, counts = len(hashes), np.zeros(BITS, np.int64)
    for at in range(0, n, 65_536):
        part = hashes[at : at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """(id, d_id, d_text, fp) of every row; ``d_id``, ``d_text`` name the row by identifier and text."""
    text_batches(docs.sparkSession)
    text = quoted(text_col)
    rows = docs.select(
        quoted(id_col).alias("id"),
        group_key(quoted(id_col)).alias("d_id"),
        F.xxhash64(text).alias("d_text"),
        text.cast("string").alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(t, shingle) for t in batch.column("text").to_pylist()]
            fp = pa.array(np.array(made, np.uint64).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], fp], ["id", "d_id", "d_text", "fp"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, d_id string, d_text long, fp long")


class BKTree:
    """A BK-tree over distinct 64-bit values, built and searched for many values at once.

    Level by level, the first value of each group becomes a node and the others go to the group of
    their distance to it. ``edges`` of a node are its children, sorted by distance.
    """

    def __init__(self, values: np.ndarray):
        self.values = values
        n = len(values)
        node = np.zeros(n, np.int64)  # the node whose child group a value waits in
        waiting = np.arange(1, n)
        parents, distances, children = [], [], []
        while len(waiting):
            d = np.bitwise_count(values[waiting] ^ values[node[waiting]]).astype(np.int64)
            group = node[waiting] * (BITS + 1) + d
            keys, first, which = np.unique(group, return_index=True, return_inverse=True)
            heads = waiting[first]
            parents.append(keys // (BITS + 1)), distances.append(keys % (BITS + 1)), children.append(heads)
            node[waiting] = heads[which]
            stay = np.ones(len(waiting), bool)
            stay[first] = False
            waiting = waiting[stay]
        parent, distance, child = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (parents, distances, children))
        key = parent * (BITS + 1) + distance
        order = np.argsort(key, kind="stable")
        self.edge_keys, self.edge_children = key[order], child[order]

    def search(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query number, value number) of all values within the radius of each query."""
        q, at = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        hits = []
        while len(q):
            d = np.bitwise_count(queries[q] ^ self.values[at]).astype(np.int64)
            near = d <= radius
            hits.append((q[near], at[near]))
            low = np.searchsorted(self.edge_keys, at * (BITS + 1) + np.maximum(d - radius, 0))
            high = np.searchsorted(self.edge_keys, at * (BITS + 1) + np.minimum(d + radius, BITS), "right")
            n = high - low
            q = np.repeat(q, n)
            at = self.edge_children[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        return tuple(np.concatenate(x) for x in zip(*hits)) if hits else (np.zeros(0, int), np.zeros(0, int))


def _forest(values: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of linked value numbers: (value, smallest value of its set), for those that are not the smallest."""
    label = np.arange(len(values))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(values)))
    return values[moved], values[label[moved]]


def _link(fps: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of one unit: a tree of its side-0 members, searched for all its members."""
    if len(fps) == 2:
        near = np.bitwise_count(fps[:1] ^ fps[1:]) <= radius
        return fps[1:][near], fps[:1][near]
    tree, others = np.sort(fps[side == 0]), np.sort(fps[side == 1])
    built = BKTree(tree)
    q, at = built.search(tree if not len(others) else others, radius)
    values = np.concatenate([tree, others])
    return _forest(values, q + (len(tree) if len(others) else 0), at)


def _shards(fps: DataFrame) -> DataFrame:
    """(shard, fp): ten rows per fingerprint; a shard is two of five bands with their values."""
    starts = [sum(BANDS[:i]) for i in range(len(BANDS))]
    made = []
    for i in range(len(BANDS)):
        for j in range(i + 1, len(BANDS)):
            value = [f"(shiftrightunsigned(fp, {starts[k]}) & {(1 << BANDS[k]) - 1})" for k in (i, j)]
            made.append(f"{len(made)} * {1 << 26} + {value[0]} * {1 << 13} + {value[1]}")
    return fps.select(F.explode(F.array(*map(F.expr, made))).alias("shard"), "fp")


def edges(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, other): a forest joining, shard by shard, distinct fingerprints within ``radius`` <= 3."""
    if not 0 <= radius <= 3:
        raise ValueError("bands are laid out for a radius of at most 3")
    shards = keep(_shards(fps))
    sizes = shards.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = shards.join(sizes, "shard").withColumn("pieces", F.ceil(F.col("n") / PIECE).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int")
    low, high = F.least(own, F.col("p")), F.greatest(own, F.col("p"))
    units = (
        members.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        .select("shard", low.alias("a"), high.alias("b"), (own != low).cast("int").alias("side"), "fp")
        .withColumn("unit", F.xxhash64("shard", "a", "b"))
    )
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = units.repartition(n, "unit").sortWithinPartitions("unit", "shard", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            columns = [batch.column(c).to_numpy().astype(np.int64) for c in ("shard", "a", "b", "side", "fp")]
            rows = np.stack(columns)
            held = np.concatenate([held, rows], axis=1) if len(held) else rows
            change = np.flatnonzero((held[:3, 1:] != held[:3, :-1]).any(axis=0)) + 1
            if len(change):
                yield _linked(held[:, : change[-1]], change[:-1], radius)
                held = held[:, change[-1] :]
        if len(held):
            yield _linked(held, np.flatnonzero((held[:3, 1:] != held[:3, :-1]).any(axis=0)) + 1, radius)

    return dealt.select("shard", "a", "b", "side", "fp").mapInArrow(run, "fp long, other long").distinct()


def _linked(rows: np.ndarray, cuts: np.ndarray, radius: int) -> pa.RecordBatch:
    """Edges of complete units, which begin at 0 and at ``cuts``."""
    found = []
    bounds = [0, *cuts.tolist(), rows.shape[1]]
    for a, b in zip(bounds, bounds[1:]):
        if b - a > 1:
            found.append(_link(rows[4, a:b], rows[3, a:b], radius))
    left, right = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found) if found else ((), ())))
    return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["fp", "other"])


def components(links: DataFrame) -> DataFrame:
    """(fp, root) of every fingerprint that has a link; all of a component have the same root.

    Each round, a fingerprint takes the least root among itself and its neighbours, and then that
    root's root. Rounds are written tables; they end when no root changes.
    """
    both = keep(links.select("fp", "other").union(links.select("other", "fp")).distinct())
    labels = keep(both.groupBy("fp").agg(F.least(F.min("other"), F.first("fp")).alias("root")))
    while True:
        roots = labels.select(F.col("fp").alias("other"), F.col("root").alias("their"))
        least = both.join(roots, "other").groupBy("fp").agg(F.min("their").alias("their"))
        met = labels.join(least, "fp").select("fp", F.col("root").alias("was"), F.least("root", "their").alias("root"))
        up = labels.select(F.col("fp").alias("root"), F.col("root").alias("higher"))
        new = keep(met.join(up, "root").select("fp", "was", F.col("higher").alias("root")))
        labels = new.select("fp", "root")
        if new.filter("root <> was").isEmpty():
            return labels


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """(rows with fp, (fp, root) of all distinct fingerprints)."""
    rows = keep(fingerprints(docs, id_col, text_col, shingle))
    fps = keep(rows.select("fp").distinct())
    roots = fps.join(components(edges(fps, radius)), "fp", "left")
    return rows, roots.select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(
    docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """(id, fingerprint, component_id) of every document, one row per input row."""
    rows, roots = _grouped(docs, id_col, text_col, shingle, radius)
    least = rows.groupBy("fp").agg(F.min("id").alias("id")).join(roots, "fp")
    named = least.groupBy("root").agg(F.min("id").alias("component_id"))
    by_fp = keep(roots.join(named, "root").select("fp", "component_id"))
    return rows.join(by_fp, "fp").select(
        "id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_first(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One document of each component: that with the smallest identifier, nulls last.

    Of rows that agree in identifier and text, one stays; the texts are shuffled once.
    """
    rows, roots = _grouped(docs, id_col, text_col, shingle, radius)
    first = F.min(F.struct(F.col("id").isNull(), "id", "d_text", "d_id"))
    by_fp = rows.groupBy("fp").agg(first.alias("first")).join(roots, "fp")
    winners = by_fp.groupBy("root").agg(F.min("first").alias("first")).select("first.d_id", "first.d_text")
    return only(docs, id_col, text_col, winners)


def only(docs: DataFrame, id_col: str, text_col: str, winners: DataFrame) -> DataFrame:
    """The rows that ``winners`` (d_id, d_text) name, each once."""
    opened = enclose(docs).withColumns(
        {"d_id": group_key(F.col(inner(docs, id_col))), "d_text": F.xxhash64(F.col(inner(docs, text_col)))}
    )
    left = opened.join(winners, ["d_id", "d_text"], "left_semi").dropDuplicates(["d_id", "d_text"])
    return reopen(left, docs)
