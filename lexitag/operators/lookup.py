"""Joins against a smaller table that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitag.operators.lasting import keep

BROADCAST_BYTES = 64 << 20
HOT_ROWS = 100_000  # a key with a partition's share of the rows is split if it has this many
HOT_KEYS = 1000, 10_000  # keys looked for: as many as shuffle partitions, within these bounds
SKETCHES = 256  # sketches of input partitions are put together in so many tasks, then in one
SPREAD = 4096  # pieces that a key holding all rows would be split into
SIEVE_BITS, SIEVE_LANES = 27, 8  # key hashes told apart by a sieve, in rows of so many longs: 2^18 rows at most


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Measure ``df``: do its rows, as text plus 16 bytes per cell, stay within ``limit``?"""
    cells = [F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in df.columns]
    row = sum(cells, F.lit(16 * len(cells)))
    size = df.agg(F.sum(row.cast("long")).alias("size")).first()["size"]
    return (size or 0) <= limit


def hot_keys(df: DataFrame, keys: Sequence[str]) -> list[tuple[int, int]]:
    """(key hash, pieces) of the keys that hold at least HOT_ROWS and as much as a mean partition.

    One sketch aggregate in two levels: no shuffle by key, one row back, a bounded number of keys.
    It only decides which keys are split, so its approximation cannot change a join's result.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = max(HOT_KEYS[0], min(HOT_KEYS[1], partitions))
    part = F.pmod(F.spark_partition_id(), F.lit(SKETCHES)).alias("_part")
    found = (
        df.select(F.xxhash64(*keys).alias("_hash"), part)
        .groupBy("_part")
        .agg(
            F.expr(f"approx_top_k_accumulate(_hash, {10 * count})").alias("sketch"),
            F.count(F.lit(1)).alias("rows"),
        )
        .groupBy(F.lit(0).alias("_all"))  # no row, rather than an empty sketch, if there are no rows
        .agg(
            F.expr(f"approx_top_k_estimate(approx_top_k_combine(sketch, {10 * count}), {count})").alias("top"),
            F.sum("rows").alias("total"),
        )
        .first()
    )
    if found is None:
        return []
    least = max(HOT_ROWS, found["total"] / count)
    top = [(r["item"], r["count"]) for r in found["top"] or [] if r["count"] >= least]
    return [(item, ceil(count / found["total"] * SPREAD)) for item, count in top]


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    salt_by: Sequence[str] = (),
    hot: list[tuple[int, int]] | None = None,
) -> DataFrame:
    """Equi-join on ``keys`` with the hot keys of ``left`` split by the columns ``salt_by``.

    Rows of ``right`` with a hot key are repeated once per piece. ``how`` is inner, left,
    left_semi or left_anti: every left row meets the right rows of its key in its own piece.
    ``hot`` takes the hot keys where they are known; without any this is a plain join.
    """
    keys = list(keys)
    hot = hot_keys(left, keys) if hot is None else hot
    if not hot:
        return left.join(right, keys, how)
    spark = left.sparkSession
    listed = F.broadcast(spark.createDataFrame(hot, "_hash long, _pieces int"))
    pieces = F.coalesce(F.col("_pieces"), F.lit(1))
    salted = (
        left.withColumn("_hash", F.xxhash64(*keys))
        .join(listed, "_hash", "left")
        .withColumn("_salt", F.pmod(F.xxhash64(*salt_by), pieces).cast("int"))
        .drop("_hash", "_pieces")
    )
    repeated = (
        right.withColumn("_hash", F.xxhash64(*keys))
        .join(listed, "_hash", "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), pieces - 1)))
        .drop("_hash", "_pieces")
    )
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")


def sifted(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``left`` but for most of those whose key is not in ``right``; keys are of one type in both.

    The hashes of the keys of ``right`` are bits of a broadcast table whose size has a bound, so
    rows are passed over before any shuffle. A row whose key only shares its hash stays.
    """
    slot = F.xxhash64(*keys).bitwiseAND((1 << SIEVE_BITS) - 1)
    number = F.shiftright(slot, 6)
    spot = (
        F.floor(number / SIEVE_LANES).alias("_cell"),
        F.pmod(number, F.lit(SIEVE_LANES)).alias("_lane"),
        F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int")).alias("_bit"),
    )
    lanes = [f"_lane{i}" for i in range(SIEVE_LANES)]

    held = [F.bit_or(F.when(F.col("_lane") == i, F.col("_bit")).otherwise(0)).alias(name) for i, name in enumerate(lanes)]
    sieve = right.select(*spot).groupBy("_cell").agg(*held)
    lane = F.col(lanes[0])
    for i, name in enumerate(lanes[1:], 1):
        lane = F.when(F.col("_lane") == i, F.col(name)).otherwise(lane)
    met = left.select("*", *spot).join(F.broadcast(sieve), "_cell").where(lane.bitwiseAND(F.col("_bit")) != 0)
    return met.select(*[f"`{c}`" for c in left.columns])


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    salt_by: Sequence[str] = (),
    measured: DataFrame | None = None,
    sift: bool = False,
    hot: list[tuple[int, int]] | None = None,
) -> DataFrame:
    """Join rows with a smaller table: broadcast if that measures small, else salted.

    ``measured`` is a kept table that ``right`` is derived from and is no larger than; it is
    measured in place of ``right``, which then is computed only once. With ``sift``, for inner
    and left_semi joins that most rows of ``left`` do not survive, these are left out before
    any shuffle and the rest is kept, so ``left`` is computed once. ``hot`` is as in salted_join.
    """
    if fits_broadcast(right if measured is None else measured):
        return left.join(F.broadcast(right), list(keys), how)
    if sift:
        left = keep(sifted(left, right if measured is None else measured, keys))
    return salted_join(left, right, keys, how, salt_by, hot)
