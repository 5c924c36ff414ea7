"""Pipe-delimited report text to typed rows.

A layout is a list of ``Kind``: a line pattern and what its groups mean. A line may match
several kinds and then gives several rows. Further layouts are further lists of ``Kind``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitag.functions import text as tx

ENCODING = "ISO-8859-1"
_MARK = "\ue000"  # a character that decoded report text cannot hold


@dataclass(frozen=True)
class Kind:
    """``pattern`` matched at line start; the other fields are group numbers, ``text`` several."""

    art: str
    pattern: str
    centre: int
    text: tuple[int, ...]
    value: int
    date: int
    year: int
    reference: int
    cost_type: int | None = None


# Line layouts of the reports, fields between bars from left to right.
_YEAR = {"current": r"\|\s+(\d{4})", "legacy": r"\|(\d{4})\s+"}
_COST = (
    r"\|(\d+\s+)\|(\d+\s+)\|[^\|]+\|(\d{2}\.\d{2}\.\d{4})\s+\|\s*([\d\.]+,\d{2}[\s-])"
    r"\|([^\|]+)\|([^\|]+)\|[^\|]+\|\s+\|(\d+|)\s+\|\d*\s*\|([^\|]+)"
)
_ASSET = (
    r"\|([^\|]+)\|\d+\s+\|\d+\s*\|(\d{2}\.\d{2}\.(\d{4}))\|([^\|]+)\|\s*([\d\.]+,\d{2})\s"
    r"\|[^\|]+\|[^\|]+\|(\d{7})[\s\d]\|\d+\s+\|"
)
_ASSET_BY_NUMBER = (
    r"\|(\d{7})\s*\|\d*\s*\|(\d{7})\s*\|\d*\s*\|(\d{2}\.\d{2}\.(\d{4}))\|([^\|]+)"
    r"\|\s*([\d\.]+,\d{2})\s\|[^\|]+\|[^\|]+\|\d*\s*\|"
)
_SMALL_ASSET = (
    r"\|[^\|]+\|(\d+\s+)\|[^\|]+\|\d+\s+\|[^\|]+\|(\d{2}\.\d{2}\.(\d{4}))"
    r"\|\s*([\d\.]+,\d{2}[\s-])\|[^\|]+\|([^\|]+)\|([^\|]+)\|([^\|]+)\|(\d+\s+|\d+|\s+)"
    r"\|\s+\d+\|\d+\s+\|[^\|]+\|[^\|]+\|([^\|]+)"
)
# Constant columns that the legacy layout adds: tag, procurement class, CKA.
LEGACY_CONSTANTS = {"Tag": "", "Beschaffungsklasse": "b", "CKA": ""}
COLUMNS = {
    "current": ["Art", "Kostenstelle", "Text", "Kostenart", "Betrag", "Datum", "Jahr", "Referenz"],
    "legacy": [
        "Art", "Kostenstelle", "Tag", "Text", "Kostenart", "Betrag", "Datum", "Jahr",
        "Beschaffungsklasse", "CKA", "Referenz",
    ],
}


def kinds(layout: str = "current") -> list[Kind]:
    cost = _YEAR[layout] + _COST
    return [
        Kind("Kosten", cost, 2, (6, 7), 5, 4, 1, 8, cost_type=3),
        Kind("Anlagen", _ASSET, 1, (4,), 5, 2, 3, 6),
        Kind("Anlagen", _ASSET_BY_NUMBER, 2, (5,), 6, 3, 4, 1),
        Kind("Anlagen", _SMALL_ASSET, 1, (5,), 4, 2, 3, 8),
    ]


def read_lines(spark: SparkSession, paths: str | Sequence[str], encoding: str = ENCODING) -> DataFrame:
    """(line): report lines, each still ending in the line break it had in the file."""
    raw = F.decode(F.col("value").cast("binary"), encoding)
    return spark.read.text(paths).select(F.concat(raw, F.lit("\n")).alias("line"))


def _fields_of(kind: Kind, line: Column) -> Column:
    """What ``kind`` takes from ``line``, in the order of ``_typed``; null where it does not match."""
    pattern = "(?Us)^" + kind.pattern
    groups = (kind.centre, kind.value, kind.date, kind.year, kind.reference)
    cost_type = f"${kind.cost_type}" if kind.cost_type else ""
    taken = [kind.art, *(f"${g}" for g in groups), cost_type, *(f"${g}" for g in kind.text)]
    row = F.regexp_replace(line, pattern + ".*$", _MARK.join(taken))
    return F.when(line.rlike(pattern), F.split(row, _MARK))


def _typed(fields: Column) -> dict[str, Column]:
    def cell(place: int) -> Column:
        return tx.strip(fields[place])

    text = F.transform(F.slice(fields, 8, F.size(fields)), tx.strip)
    return {
        "Art": fields[0],
        "Kostenstelle": cell(1),
        "Text": tx.none_to_empty(F.upper(F.array_join(text, " "))),
        "Kostenart": cell(6),
        "Betrag": tx.amount(fields[2]),
        "Datum": tx.day(fields[3]),
        "Jahr": cell(4),
        "Referenz": cell(5),
    }


Layout = str | Sequence[Kind]


def parse_report(lines: DataFrame, layout: Layout = "current", keep: Sequence[str] = ()) -> DataFrame:
    """(line) -> typed rows, with the columns ``keep`` of ``lines`` in front. No shuffle.

    ``layout`` is the name of a known layout or the kinds of an own one, whose rows have the columns
    of the current layout. Each pattern runs over a line once; the groups of a match come out of one replacement.
    """
    named = isinstance(layout, str)
    known = kinds(layout) if named else list(layout)
    line = F.col("line")
    matched = lines.where(line.startswith("|")).select(
        *keep, *[_fields_of(k, line).alias(f"_kind{i}") for i, k in enumerate(known)]
    )
    found = F.array_compact(F.array(*[c for c in matched.columns if c not in keep]))
    fields = F.col("_fields")
    rows = (
        matched.select(*keep, F.explode(found).alias("_fields"))
        .where(tx.strip(fields[1]).rlike(r"^[\p{Nd}²³¹]+\z"))
        .select(*keep, *[c.alias(n) for n, c in _typed(fields).items()])
    )
    if layout == "legacy":
        rows = rows.withColumns({c: F.lit(v) for c, v in LEGACY_CONSTANTS.items()})
    return rows.select(*keep, *COLUMNS[layout if named else "current"])


def read_report(
    spark: SparkSession, paths: str | Sequence[str], layout: Layout = "current"
) -> DataFrame:
    return parse_report(read_lines(spark, paths), layout)
