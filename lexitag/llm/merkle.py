r"""Merkle manifest of a table: any row can be proved to belong to one root, by the runs it lies in.

A row's leaf is the SHA-256 of its columns. Leaves of a group ascend by identifier; every 16 in a row
become their hash (the last run may be shorter, even one), until one is left, the group's root. The
roots of all groups, in order of their groups, form the same kind of tree, whose root names the table.

Every aligned block of 256 nodes is one row that keeps a level as one string of concatenated hex
digests. A parent is the hash of a fixed-width substring of that string, and a node's siblings are
the two substrings that flank it in its run. Blocks leave one node each, which are dealt to blocks
again until one is left. On the way back every node hands its flanks to the block below it, so a
leaf's path is put together within its block's row. No task sees more than 256 nodes at a time; the
leaves of a group of any size are numbered by range partitions and the sums of their sizes. Texts are
read once and never shuffled.

Defined cases: a null is a value of its own in a leaf; a null identifier comes first in its group;
equal identifiers lie in order of their leaves, and repeated rows are leaves each; a null group is the
first one; a group of one row has its leaf as root; no rows give no rows and no root; other columns
of the table, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexitag.llm.common import ascii_lower, crc_text, group_key, quoted
from lexitag.operators.lasting import keep
from lexitag.operators.lookup import lookup_join

RUN = 16
BLOCK = RUN * RUN
HEX = 64
TAMPERED_ONE_IN = 5


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(columns: Sequence[Column]) -> Column:
    """The digest of a row: every column as its UTF-8 byte count, a colon and its text, or a dash."""
    texts = [c.cast("string") for c in columns]
    return digest(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)))


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def _nodes(level: Column, at: Column, count: int) -> Column:
    """``count`` nodes of a level string from node ``at`` on; fewer at its end."""
    return F.substring(level, (at * HEX + 1).cast("int"), F.lit(count * HEX))


def _parents(level: Column, size: Column) -> Column:
    """The level above, as one string."""
    runs = F.sequence(F.lit(0), F.floor((size - 1) / RUN).cast("int"))
    return F.array_join(F.transform(runs, lambda r: digest(_nodes(level, r * RUN, RUN))), "")


def _flanks(level: Column, at: Column) -> Column:
    """The siblings of node ``at`` in its run: left of it and right of it."""
    place = F.pmod(at, F.lit(RUN))
    left = F.substring(level, ((at - place) * HEX + 1).cast("int"), (place * HEX).cast("int"))
    right = F.substring(level, ((at + 1) * HEX + 1).cast("int"), ((RUN - 1 - place) * HEX).cast("int"))
    return F.struct(left.alias("left"), right.alias("right"))


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds ``pos`` (from 0, by ``order``) and ``total`` of each row's group ``g``.

    ``rows`` is a kept table. Its rows are sorted by range partitions; a row's number is its place in
    its partition and the sum of the group's rows in partitions before. What is summed up has one row
    per partition and group.
    """
    placed = rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order)
    placed = keep(placed.withColumn("at", F.monotonically_increasing_id()))
    placed = placed.withColumn("part", F.call_function("shiftright", "at", F.lit(33)))
    whole = Window.partitionBy("g")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = keep(
        placed.groupBy("g", "part")
        .agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
        .withColumns({"before": F.coalesce(F.sum("n").over(before), F.lit(0)), "total": F.sum("n").over(whole)})
        .drop("n")
    )
    joined = lookup_join(placed, runs, ["g", "part"], "inner", salt_by=["at"])
    return joined.withColumn("pos", F.col("at") - F.col("first") + F.col("before")).drop("at", "part", "first", "before")


def _blocks(nodes: DataFrame, carry: Sequence[str]) -> DataFrame:
    """The kept blocks of nodes (g, total, pos, digest, ...): both of their levels and the node they leave."""
    item = F.struct("pos", "digest", *carry)
    made = (
        nodes.withColumn("block", F.floor(F.col("pos") / BLOCK).cast("long"))
        .groupBy("g", "total", "block")
        .agg(F.sort_array(F.collect_list(item)).alias("items"))
    )
    size = F.size("items")
    height = F.when(F.col("total") == 1, 0).when(F.col("total") <= RUN, 1).otherwise(2)
    first = F.array_join(F.transform("items", lambda x: x["digest"]), "")

    def levels(low: Column) -> Column:
        node = lambda high: F.when(height == 0, low).when(height == 1, high).otherwise(digest(high))
        both = lambda high: F.struct(low.alias("low"), high.alias("high"), node(high).alias("node"))
        return _with(_parents(low, size), both)

    bare = F.transform("items", lambda x: F.struct(x["pos"].alias("pos"), *(x[c].alias(c) for c in carry)))
    rows = made.select("g", "total", "block", bare.alias("items"), height.alias("height"), _with(first, levels).alias("l"))
    return keep(rows.select("g", "total", "block", "items", "height", "l.low", "l.high", "l.node"))


@dataclass
class Tree:
    """Blocks of nodes, then blocks of what they leave, until every group has one block."""

    rounds: list[DataFrame]
    carry: Sequence[str]

    def tops(self) -> DataFrame:
        """(g, digest) of each group."""
        ends = [b.filter(F.col("total") <= BLOCK).select("g", F.col("node").alias("digest")) for b in self.rounds]
        whole = ends[0]
        for more in ends[1:]:
            whole = whole.unionByName(more)
        return whole

    def paths(self, above: DataFrame) -> DataFrame:
        """(g, pos, digest, carried columns, path, what else ``above`` has) of every node.

        ``above`` has (g, path, ...) of each group: how its top goes on.
        """
        handed = [c for c in above.columns if c not in ("g", "path")]
        below = None
        for level in reversed(range(len(self.rounds))):
            blocks = self.rounds[level]
            ends = above.withColumn("block", F.lit(0).cast("long")).join(
                blocks.filter(F.col("total") <= BLOCK).select("g"), "g", "left_semi"
            )
            up = ends if below is None else ends.unionByName(below.withColumnRenamed("pos", "block"))
            # Blocks are small beside the hashing that their rows lead to, so they are dealt out by number, not size.
            parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            joined = lookup_join(blocks.repartition(parts, "g", "block"), keep(up), ["g", "block"], "inner", ["block"])
            below = self._down(joined, self.carry if level == 0 else [], handed)
            if level:
                below = below.select("g", "pos", "path", *handed)
        return below

    def _down(self, blocks: DataFrame, carry: Sequence[str], handed: Sequence[str]) -> DataFrame:
        """Every node of the blocks with its own flanks before its block's path."""
        none = F.array().cast("array<struct<left:string,right:string>>")

        def one(item: Column, i: Column) -> Column:
            first = F.when(F.col("height") > 0, F.array(_flanks(F.col("low"), i))).otherwise(none)
            second = F.when(F.col("height") > 1, F.array(_flanks(F.col("high"), F.floor(i / RUN)))).otherwise(none)
            return F.struct(
                item["pos"].alias("pos"),
                _nodes(F.col("low"), i, 1).alias("digest"),
                *(item[c].alias(c) for c in carry),
                F.concat(first, second, F.col("path")).alias("path"),
            )

        return blocks.select("g", *handed, F.inline(F.transform("items", one)))


def tree(nodes: DataFrame, carry: Sequence[str] = ()) -> Tree:
    """The tree over numbered nodes (g, total, pos, digest, ``carry``); one row, the largest group's size, comes back."""
    most = nodes.agg(F.max("total").alias("most")).first()["most"] or 0
    rounds = [_blocks(nodes, carry)]
    while most > BLOCK:
        most = -(-most // BLOCK)
        left = rounds[-1].filter(F.col("total") > BLOCK)
        total = F.ceil(F.col("total") / BLOCK).cast("long").alias("total")
        rounds.append(_blocks(left.select("g", total, F.col("block").alias("pos"), F.col("node").alias("digest")), ()))
    return Tree(rounds, carry)


@dataclass
class Manifest:
    """``root`` names the whole table; ``groups`` is (g, subroot), the trees hold every digest."""

    rows: Tree
    groups: Tree
    root: str | None

    def proofs(self) -> DataFrame:
        """(id, leaf, subroot, root, path, carried columns) of every row; wide, so filter or digest it at once.

        ``path`` has the siblings (left, right) of each level from the leaf's run up to the root.
        """
        none = F.array().cast("array<struct<left:string,right:string>>")
        start = self.groups.tops().select("g", none.alias("path"))
        tops = self.groups.paths(start).select(
            F.col("group").alias("g"), "path", F.col("digest").alias("subroot"), F.lit(self.root).cast("string").alias("root")
        )
        found = self.rows.paths(tops)
        return found.select("id", F.col("digest").alias("leaf"), "subroot", "root", "path", *self.rows.carry[1:])


def manifest(
    table: DataFrame, columns: Sequence[str], id_col: str, group_col: str, carry: Mapping[str, Column] | None = None
) -> Manifest:
    """Leaves of ``columns``, numbered within their groups, and both trees.

    ``carry`` are further expressions over the table that go with a leaf into its proof.
    """
    more = dict(carry or {})
    leaves = keep(
        table.select(
            group_key(quoted(group_col)).alias("g"),
            quoted(id_col).alias("id"),
            leaf([quoted(c) for c in columns]).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
            *(e.alias(name) for name, e in more.items()),
        )
    )
    rows = tree(numbered(leaves, ["id", "digest", "row"]), ["id", *more])
    tops = keep(rows.tops().select(F.lit("").alias("g"), F.col("g").alias("group"), "digest"))
    groups = tree(numbered(tops, ["group"]), ["group"])
    root = groups.tops().first()
    return Manifest(rows, groups, root["digest"] if root else None)


def path_digest(path: Column) -> Column:
    """The digest of all siblings of a path, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and a path's siblings give."""
    return F.aggregate(path, start, lambda node, s: digest(F.concat(s["left"], node, s["right"])))


def lower_cased(columns: Sequence[str], id_col: str, text_col: str) -> Column:
    """The leaf after tampering, or null for rows left alone: every fifth row by its identifier's
    checksum, a null one not, has its text's A-Z in lower case."""
    changed = [ascii_lower(quoted(c)) if c == text_col else quoted(c) for c in columns]
    hit = quoted(id_col).isNotNull() & (crc_text(quoted(id_col)) % TAMPERED_ONE_IN == 0)
    return F.when(hit, leaf(changed))


def report(table: DataFrame, columns: Sequence[str], id_col: str, group_col: str, text_col: str) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row, some tampered with."""
    made = manifest(table, columns, id_col, group_col, {"tampered": lower_cased(columns, id_col, text_col)})
    return (
        made.proofs()
        .withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("path")))
        .select(
            "id",
            "leaf",
            "subroot",
            "root",
            path_digest(F.col("path")).alias("proof_sha256"),
            "folded_root",
            (F.col("folded_root") == F.col("root")).alias("verified"),
        )
    )


#: The same in DuckDB SQL over ``documents``.
SQL = r"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, * FROM documents),
fields AS (
  SELECT r, doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS g,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    strlen(text) || ':' AS size, text,
    xor(list_reduce(list_prepend(4294967295::UBIGINT,
          list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
        lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0],
          lambda x, y: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))), 4294967295::UBIGINT) % 5 = 0 AS hit
  FROM docs),
leaves AS (
  SELECT r, doc_id, g, sha256(head || coalesce(size || text, '-')) AS leaf,
    sha256(head || coalesce(size || CASE WHEN hit THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz') ELSE text END, '-')) AS held
  FROM fields),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
tree AS (
  SELECT g, 0 AS lvl, pos, leaf AS h FROM placed
  UNION ALL
  SELECT g, lvl + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM tree) WHERE n > 1 GROUP BY g, lvl, pos // 16),
nodes AS (SELECT *, count(*) OVER (PARTITION BY g, lvl) AS n FROM tree),
tops AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS pos FROM nodes WHERE n = 1),
above AS (
  SELECT 0 AS lvl, pos, h FROM tops
  UNION ALL
  SELECT lvl + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER () AS n FROM above) WHERE n > 1 GROUP BY lvl, pos // 16),
every AS (
  SELECT g, lvl, pos, h, n FROM nodes
  UNION ALL
  SELECT NULL, 100 + lvl, pos, h, count(*) OVER (PARTITION BY lvl) FROM above),
flanks AS (
  SELECT g, lvl, pos,
    coalesce(string_agg(h, '') OVER (PARTITION BY g, lvl, pos // 16 ORDER BY pos
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,
    coalesce(string_agg(h, '') OVER (PARTITION BY g, lvl, pos // 16 ORDER BY pos
      ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt
  FROM every WHERE n > 1),
steps AS (
  SELECT r, lvl, lft, rgt, row_number() OVER (PARTITION BY r ORDER BY lvl) AS k
  FROM (
    SELECT p.r, f.lvl, f.lft, f.rgt FROM placed p JOIN flanks f ON f.g = p.g AND f.pos = p.pos >> (4 * f.lvl)
    UNION ALL
    SELECT p.r, f.lvl, f.lft, f.rgt FROM placed p JOIN tops t ON t.g = p.g
    JOIN flanks f ON f.g IS NULL AND f.pos = t.pos >> (4 * (f.lvl - 100)))),
fold AS (
  SELECT r, 0::BIGINT AS k, held AS node FROM placed
  UNION ALL
  SELECT fold.r, s.k, sha256(s.lft || fold.node || s.rgt) FROM fold JOIN steps s ON s.r = fold.r AND s.k = fold.k + 1),
proofs AS (SELECT r, sha256(string_agg(lft || rgt, '' ORDER BY k)) AS proof FROM steps GROUP BY r),
root AS (SELECT h FROM above ORDER BY lvl DESC LIMIT 1)
SELECT p.doc_id, p.leaf, t.h AS subroot, root.h AS root, coalesce(s.proof, sha256('')) AS proof_sha256,
  d.node AS folded_root, d.node = root.h AS verified
FROM placed p JOIN tops t ON t.g = p.g JOIN root ON true LEFT JOIN proofs s ON s.r = p.r
JOIN (SELECT r, arg_max(node, k) AS node FROM fold GROUP BY r) d ON d.r = p.r
"""
