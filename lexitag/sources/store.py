"""Tables of a trained model, one Parquet folder each, and the legacy vocabularies."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitag.operators.model import TagModel

# Names of the stored tables.
LEARN = "plain_initial_data"
WORDS = "initial_data"
COLUMNS = "data_column_names"
WEIGHTS = "data_weights"
PROBABILITIES = "data_probabilities"
MULTI = "data_multi_probabilities"
UNIQUE = "data_unique_probabilities"
LEGACY = {
    "learn": "learn_data",
    "relevance": "rel_ngrams_text",
    "tags": "gen_ngrams_text",
    "columns": "rel_ngrams_col",
    "fill": "other_col_values",
}


def save_table(df: DataFrame, folder: str, name: str, by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(f"{folder}/{name}")


def load_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")


def has_table(spark: SparkSession, folder: str, name: str) -> bool:
    try:
        load_table(spark, folder, name)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
    return True


def files_mark(spark: SparkSession, paths: str | Sequence[str]) -> str:
    """A mark of the files under paths or globs: of their names, sizes and times; none is opened."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    files = spark.read.format("binaryFile").load(paths)
    told = [F.xxhash64(F.lit(i), "path", "length", "modificationTime") for i in range(2)]
    return "-".join(str(v) for v in files.agg(F.count("path"), *(F.bit_xor(t) for t in told)).first())


def fingerprint(*settings) -> str:
    return hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()


def _mark_of(spark: SparkSession, folder: str, name: str):
    """The marker's file system and path, below a folder that readers of tables pass over."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_made/{name}")
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def made_of(spark: SparkSession, folder: str, name: str) -> str | None:
    """What a stored table was made of; None while it is not whole."""
    jvm, (system, place) = spark.sparkContext._jvm, _mark_of(spark, folder, name)
    if not system.exists(place):
        return None
    lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(system.open(place), "UTF-8"))
    try:
        return lines.readLine()
    finally:
        lines.close()


def saved_or_built(
    spark: SparkSession, folder: str, name: str, build, rebuild: bool = False, of: str = ""
) -> DataFrame:
    """The stored table; it is built and stored first if it is missing, was left half-written or was
    made of something else than ``of`` says, or if a rebuild is asked for.

    The marker goes before the first file is written and comes back after the last one.
    """
    if rebuild or made_of(spark, folder, name) != of or not has_table(spark, folder, name):
        system, place = _mark_of(spark, folder, name)
        system.delete(place, False)
        save_table(build(), folder, name)
        out = system.create(place, True)
        out.writeBytes(of + "\n")
        out.close()
    return load_table(spark, folder, name)


def column_names(spark: SparkSession, model: TagModel) -> DataFrame:
    """Ordered catalogue of the learn columns with a mark on the tag columns."""
    rows = [(i, c, c in model.tag_cols) for i, c in enumerate(model.columns)]
    return spark.createDataFrame(rows, "position int, data_col_names string, is_tag boolean")


def save_column_tags(df: DataFrame, folder: str) -> None:
    save_table(df, folder, LEGACY["columns"], ("col",))


def fill_column_names(fill: DataFrame) -> list[str]:
    """Columns that have fill values (one row per column comes back)."""
    return sorted(r["Col"] for r in fill.select("Col").distinct().collect())
