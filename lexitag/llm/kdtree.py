"""Exact top-k by inner product with KD-trees per shard.

Candidates are dealt to shards of about ``SHARD_ROWS`` by a hash of their identifier. A shard's tree
splits at the median of its widest dimension down to leaves of ``LEAF`` rows; every node has the
tight box around its rows. For a query, a box bounds the inner product from above by the sum of
max(q * low, q * high); the search goes on at the node with the best bound and ends when that bound
is below the k-th score found. First each query is searched in one shard only; the k-th score found
there is handed on, so that the searches of all other shards can leave out most of their trees from
the start. Boxes are bounded and leaves scored for a block of queries at a time.

Queries are sent to shards in blocks of ``BLOCK``; their number times the number of shards is what
any exact search against all rows costs, and no row is sent per pair. Each shard returns at most k
rows a query, and the last choice among them is a top-k by rank.

Ties go to the smaller identifier: nodes whose bound equals the k-th score are searched too. Defined
cases: vectors that are null, empty or hold a null or non-finite component take no part, nor do rows
without an identifier, nor pairs of different length; a query's own row is no candidate, rows
that repeat an identifier are candidates each, unless it is the query's own, and a repeated query
has one result; with fewer than k candidates all are returned; no rows give no rows; other columns
of the input, whatever their names, are not read. Scores beyond a 64-bit integer end at its limits,
and are ties there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexitag.llm.common import quoted
from lexitag.operators.lasting import keep

SHARD_ROWS = 4096
LEAF = 64
BLOCK = 256


def scaled(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) of each component, in double precision; null if a component is not finite."""
    x = vector.cast("array<double>")
    limit = F.lit(float("inf"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < limit))
    whole = F.transform(x, lambda v: F.rint(F.floor(v * F.lit(float(factor))).cast("double")))
    large = F.transform(x, lambda v: v * F.lit(float(factor)))  # beyond 2^53 every double is whole
    exact = F.forall(x, lambda v: F.abs(v) < F.lit(2.0**40))
    return F.when((F.size(x) > 0) & finite, F.when(exact, whole).otherwise(large))


class KDTree:
    """Rows in leaf order, and per level the tight boxes of its nodes, for one shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.arange(len(ids))
        self.first, self.last, self.left, self.right, self.low, self.high = [], [], [], [], [], []

        def build(a: int, b: int) -> int:
            node = len(self.first)
            rows = vectors[order[a:b]]
            low, high = rows.min(axis=0), rows.max(axis=0)
            for column, value in zip(
                (self.first, self.last, self.left, self.right, self.low, self.high), (a, b, -1, -1, low, high)
            ):
                column.append(value)
            if b - a > LEAF:
                middle = (b - a) // 2
                along = rows[:, int(np.argmax(high - low))]
                order[a:b] = order[a:b][np.argpartition(along, middle, kind="introselect")]
                self.left[node] = build(a, a + middle)
                self.right[node] = build(a + middle, b)
            return node

        build(0, len(ids))
        self.ids, self.vectors = ids[order], vectors[order]
        self.low, self.high = np.array(self.low), np.array(self.high)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """(queries x nodes) upper bounds of the inner products."""
        return _limited(np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T)

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, known: list) -> list[list[tuple]]:
        """Per query up to k (score, -id), best first; ``known``: a k-th score found elsewhere."""
        import heapq

        bounds = self.bounds(queries)
        found = []
        for q, query in enumerate(queries):
            bound = bounds[q]
            best: list[tuple] = []
            least = known[q]
            nodes = [(-bound[0], 0)]
            while nodes and -nodes[0][0] >= least:
                node = heapq.heappop(nodes)[1]
                if self.left[node] >= 0:
                    for child in (self.left[node], self.right[node]):
                        if bound[child] >= least:
                            heapq.heappush(nodes, (-bound[child], child))
                    continue
                a, b = self.first[node], self.last[node]
                scores = _limited(self.vectors[a:b] @ query)
                for i in np.flatnonzero(scores >= least):
                    item = (scores[i], -int(self.ids[a + i]))
                    if -item[1] == own[q]:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
                if len(best) == k:
                    least = max(least, best[0][0])
            found.append(sorted(best, reverse=True))
        return found


def _limited(scores: np.ndarray) -> np.ndarray:
    """Scores as 64-bit integers can hold them; doubles are only used where they all can."""
    return np.clip(scores, -(2**63), 2**63 - 1) if scores.dtype == object else scores


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy()
    return flat.reshape(len(column), -1)


def _exact(vectors: np.ndarray) -> np.ndarray:
    """Doubles where every inner product is exact in them, else Python's whole numbers."""
    most = np.abs(vectors).max(initial=0)
    if most * most * max(1, vectors.shape[1]) < 2.0**53:
        return vectors
    return np.array([[int(x) for x in row] for row in vectors.tolist()], dtype=object)


def _search(tree: KDTree, ids: np.ndarray, vectors: np.ndarray, known: list, k: int) -> pa.RecordBatch:
    rows = [
        (int(i), -minus, int(score))
        for i, best in zip(ids, tree.search(vectors, ids, k, known))
        for score, minus in best
    ]
    query, vec, score = zip(*rows) if rows else ((), (), ())
    columns = [pa.array(c, pa.int64()) for c in (query, vec, score)]
    return pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score"])


def _searched(rows: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score) of each shard's candidates (kind 0) for the queries sent to it (kind 1).

    Rows come sorted by shard, kind and block: a shard's tree is built once, then blocks go through it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, held, current = None, [], None

        def flush() -> pa.RecordBatch | None:
            nonlocal tree, held
            table = pa.Table.from_batches(held).combine_chunks() if held else None
            held = []
            if table is None or not table.num_rows:
                return None
            batch = table.to_batches()[0]
            ids, vectors = batch.column("id").to_numpy(), _exact(_matrix(batch.column("v")))
            if current[2] == 0:
                tree = KDTree(ids, vectors)
                return None
            known = [-np.inf if x is None else x for x in batch.column("known").to_pylist()]
            return _search(tree, ids, vectors, known, k) if tree else None

        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy() for c in ("shard", "width", "kind", "block")])
            cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                mark = tuple(marks[:, a].tolist()) if b > a else current
                if mark != current:
                    out = flush()
                    if out is not None:
                        yield out
                    if current is None or mark[:2] != current[:2]:
                        tree = None
                    current = mark
                held.append(batch.slice(a, b - a))
        out = flush()
        if out is not None:
            yield out

    wanted = rows.select("shard", "width", "kind", "block", "id", "v", "known")
    return wanted.mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best candidates by inner product.

    Both tables have ``id_col`` and ``vector_col``; the vectors are arrays of whole numbers as doubles.
    """

    def rows(df: DataFrame) -> DataFrame:
        v = quoted(vector_col).cast("array<double>")
        named = df.select(quoted(id_col).cast("long").alias("id"), v.alias("v"))
        return named.dropna().withColumn("width", F.size("v"))

    candidates = keep(rows(vectors))
    asked = keep(rows(queries).groupBy("id").agg(F.first("v").alias("v")).withColumn("width", F.size("v")))
    shards = max(1, -(-candidates.count() // SHARD_ROWS))
    blocks = max(1, -(-asked.count() // BLOCK))
    number = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(n)).cast("int")
    none = F.lit(None).cast("long")
    placed = candidates.select(
        F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int").alias("shard"),
        "width", F.lit(0).alias("kind"), F.lit(0).alias("block"), "id", "v", none.alias("known"),
    )
    home = number(shards, 1)
    block = number(blocks, 2).alias("block")

    def search(sent: DataFrame) -> DataFrame:
        both = placed.unionByName(sent.select("shard", "width", F.lit(1).alias("kind"), "block", "id", "v", "known"))
        dealt = both.repartitionById(shards, F.col("shard"))
        return keep(_searched(dealt.sortWithinPartitions("shard", "width", "kind", "block"), k))

    first = search(asked.withColumns({"shard": home, "block": number(blocks, 2), "known": none}))
    kth = first.groupBy("query_id").agg(
        F.when(F.count("score") >= k, F.min("score")).alias("known")
    )
    rest = (
        asked.join(kth, asked["id"] == kth["query_id"], "left")
        .select("id", "v", "width", "known", block, home.alias("home"))
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        .filter("shard <> home")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        first.unionByName(search(rest))
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


#: The same in DuckDB SQL over ``embeddings``.
SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER best AS rank, vec_id, score FROM scored
WINDOW best AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER best <= 5
"""
