r"""Secret scans: spans of secrets, and weaker parts of credentials where they complete each other.

Three base kinds always count: values assigned to words such as ``password`` (``assign``), access
identifiers (``access``) and long hexadecimal runs (``hex``). Other parts are weak, each alone being
as likely harmless: short values and identifiers of the base kinds (``part_assign``, ``part_access``),
values assigned to names of accounts (``login``), to further words for secrets (``pass``), and
addresses of services (``endpoint``). A weak part is reported only with a complementary one: a secret
beside an identifier or endpoint, or one of these beside a secret, the base kinds included. Parts are
beside each other if they lie in one scope, a stretch of text without a blank line, and start at most
``REACH`` code points apart.

Patterns run in the JVM. Positions come from the lengths of the matches and of what lies between
them, summed up over a document's matches. Parts are joined by interval: they are put into cells of
``REACH`` code points, of which only the first and last start per role are kept, so a part meets at
most three rows however many parts lie around it and no pairs come up. A document's spans are grouped
by row; rows without any match take no part in that and texts are never shuffled.

Defined cases: a null text is an empty one; an empty text has no spans; matches of one kind never
overlap, those of different kinds may; repeated rows are scanned each; null identifiers are handed on;
no documents give no rows; other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexitag.llm.common import quoted
from lexitag.operators.lasting import keep

REACH = 200
# What the base kinds match, and the least length of what counts.
VALUE = r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_WORDS = "password|passwd|secret|token|api_?key"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{16,}"  # a run of fewer is no match; runs end where they cannot go on
LEAST_VALUE, LEAST_ACCESS = 12, 18
# Own values: the weak parts.
LOGIN_WORDS = "user|user_?name|login|account|client_?id|key_?id"
PASS_WORDS = "pass|pwd|auth|credentials?|private_?key|secret_?key|access_?key"
HOST_WORDS = "host|server|endpoint|bucket|database"
PART_VALUE, PART_ACCESS, LOGIN_VALUE = 6, 12, 3
BREAK = r"\n[\x20\t\r]*\n"
#: No search with an assignment or address matches without this, which is found faster.
SIGN = r"""[:=]\x20*["']?[A-Za-z0-9+/_.=-]"""
SIGNED = ("assign", "login", "pass", "endpoint")


def either_case(words: str) -> str:
    """A pattern for these words with ASCII letters of either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


#: What is searched for, and the group whose length counts (0: the whole match).
SEARCHES = {
    "assign": (f"({either_case(ASSIGN_WORDS)}){VALUE}", 2),
    "access": (ACCESS, 0),
    "hex": (HEX, 0),
    "login": (f"({either_case(LOGIN_WORDS)}){VALUE}", 2),
    "pass": (f"({either_case(PASS_WORDS)}){VALUE}", 2),
    "endpoint": (
        f"({either_case('https?')}://[A-Za-z0-9._~:/?=&%@-]+|({either_case(HOST_WORDS)})"
        r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9][A-Za-z0-9+/_.:=-]*)""",
        0,
    ),
    "break": (BREAK, 0),
}
#: (kind, searched as, least and most length of what counts, is it a secret, is it weak), in output order.
KINDS = (
    ("assign", "assign", LEAST_VALUE, None, True, False),
    ("access", "access", LEAST_ACCESS, None, False, False),
    ("hex", "hex", 0, None, True, False),
    ("part_assign", "assign", PART_VALUE, LEAST_VALUE - 1, True, True),
    ("part_access", "access", PART_ACCESS, LEAST_ACCESS - 1, False, True),
    ("login", "login", LOGIN_VALUE, None, False, True),
    ("pass", "pass", PART_VALUE, None, True, True),
    ("endpoint", "endpoint", 0, None, False, True),
)
BASE = 3  # so many kinds at the start are the base ones
_WEAK = tuple(s for _, s, _, _, _, weak in KINDS if weak)


def _matches(text: Column, search: str) -> Column:
    """Of every match: its number, the length of the text since the last one, its length, its value's length."""
    pattern, group = SEARCHES[search]
    lengths = lambda texts: F.transform(texts, lambda x: F.char_length(x))
    found = lambda g: lengths(F.regexp_extract_all(text, F.lit(pattern), F.lit(g)))
    both = F.zip_with(found(0), found(group), lambda n, v: F.struct(n.alias("n"), v.alias("value")))
    rows = F.zip_with(
        lengths(F.split(text, pattern, -1)),
        both,
        lambda gap, m: F.struct(gap.alias("gap"), m["n"].alias("n"), m["value"].alias("value")),
    )
    fields = lambda m: (m[c].alias(c) for c in ("gap", "n", "value"))
    numbered = F.transform(
        F.filter(rows, lambda m: m["n"].isNotNull()),
        lambda m, i: F.struct(F.lit(search).alias("search"), i.alias("i"), *fields(m)),
    )
    return F.when(text.rlike(pattern), numbered)


def matches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, found) of every document, kept; ``found`` is null where nothing matches."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        quoted(id_col).alias("id"),
        F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("text"),
    )
    text = F.col("text")
    names = [s for s in SEARCHES if s != "break"]
    rows = rows.withColumn("signed", text.rlike(SIGN))
    rows = rows.withColumns({f"m_{s}": F.when(F.col("signed"), _matches(text, s)) if s in SIGNED else _matches(text, s) for s in names})
    weak = F.lit(False)
    for s in dict.fromkeys(_WEAK):
        weak = weak | F.col(f"m_{s}").isNotNull()
    none = F.array().cast("array<struct<search:string,i:int,gap:int,n:int,value:int>>")
    breaks = F.when(weak, _matches(text, "break"))
    every = F.concat(*(F.coalesce(F.col(f"m_{s}"), none) for s in names), F.coalesce(breaks, none))
    return keep(rows.select("row", "id", every.alias("found")))


def _kind(rows: DataFrame) -> DataFrame:
    """Adds kind (its place in KINDS, null for none), secret and weak."""
    kind, secret, weak = F.lit(None).cast("int"), F.lit(None).cast("boolean"), F.lit(False)
    for at, (_, search, least, most, is_secret, is_weak) in enumerate(KINDS):
        fits = (F.col("search") == search) & (F.col("value") >= least)
        fits = fits if most is None else fits & (F.col("value") <= most)
        kind = F.when(fits, F.lit(at)).otherwise(kind)
        secret = F.when(fits, F.lit(is_secret)).otherwise(secret)
        weak = F.when(fits, F.lit(is_weak)).otherwise(weak)
    return rows.withColumns({"kind": kind, "secret": secret, "weak": weak})


def parts(found: DataFrame) -> DataFrame:
    """(row, id, kind, start, end, scope, secret, weak) of every match, kept; kind is null for what counts for nothing."""
    rows = found.filter(F.size("found") > 0).select("row", "id", F.explode("found").alias("m")).select("row", "id", "m.*")
    whole = Window.partitionBy("row")
    end = F.sum(F.col("gap") + F.col("n")).over(Window.partitionBy("row", "search").orderBy("i"))
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("n"))
    is_break = F.when(F.col("search") == "break", 1).otherwise(0)
    rows = rows.withColumn("scope", F.sum(is_break).over(whole.orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    return keep(_kind(rows).select("row", "id", "kind", "start", "end", "scope", "secret", "weak"))


def linked(rows: DataFrame) -> DataFrame:
    """(row, kind, start) of the weak parts that a complementary part lies beside."""
    cell = F.floor(F.col("start") / REACH).cast("long")
    real = rows.filter(F.col("kind").isNotNull()).withColumn("cell", cell)
    cells = real.groupBy("row", "scope", "cell", "secret").agg(F.min("start").alias("first"), F.max("start").alias("last"))
    around = F.explode(F.array(*(F.col("cell") + k for k in (-1, 0, 1)))).alias("cell")
    weak = real.filter("weak").select("row", "scope", (~F.col("secret")).alias("secret"), "kind", "start", around)
    # Of the cell before, the last start decides, of the cell after, the first one.
    near = (F.col("last") >= F.col("start") - REACH) & (F.col("first") <= F.col("start") + REACH)
    return weak.join(cells, ["row", "scope", "cell", "secret"]).filter(near).select("row", "kind", "start").distinct()


def spans(found: DataFrame) -> DataFrame:
    """(row, id, spans) of the documents of ``matches`` that have any match.

    ``spans`` is an array of (start, kind, end): all base ones and the weak ones with a complement,
    by start, then kind as in KINDS.
    """
    rows = parts(found)
    flags = linked(rows).withColumn("linked", F.lit(True))
    reported = F.col("kind").isNotNull() & (~F.col("weak") | F.coalesce("linked", F.lit(False)))
    span = F.struct(F.col("start").cast("long").alias("start"), F.col("kind").alias("kind"), F.col("end").cast("long").alias("end"))
    return (
        rows.join(flags, ["row", "kind", "start"], "left")
        .groupBy("row", "id")
        .agg(F.sort_array(F.collect_list(F.when(reported, span))).alias("spans"))
    )


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, spans) of every document, one row per input row; ``spans`` has (start, kind, end)."""
    found = matches(docs, id_col, text_col)
    rows = spans(found).select("id", "spans")
    none = F.array().cast(rows.schema["spans"].dataType)
    return rows.unionByName(found.filter("size(found) = 0").select("id", none.alias("spans")))


def as_text(found: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    names = F.array(*(F.lit(name) for name, *_ in KINDS))
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(found, one), ",")


def report(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans as text) of every document."""
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < BASE)
    return scan(docs, id_col, text_col).select(
        "id",
        *(of(at).alias(f"n_{KINDS[at][0]}") for at in range(BASE)),
        F.sha2(as_text(base).cast("binary"), 256).alias("base_sha256"),
        as_text(F.col("spans")).alias("spans"),
    )


def _sql() -> str:
    """The same in DuckDB SQL over ``documents``, for the patterns and bounds above."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    found = " UNION ALL ".join(
        f"SELECT r, {text(s)} AS search, list_transform(string_split_regex(text, {text(p)}), lambda x: length(x)) AS gaps, "
        f"list_transform(regexp_extract_all(text, {text(p)}, 0), lambda x: length(x)) AS ns, "
        f"list_transform(regexp_extract_all(text, {text(p)}, {g}), lambda x: length(x)) AS vals "
        f"FROM docs WHERE regexp_matches(text, {text(p)})"
        for s, (p, g) in SEARCHES.items()
    )
    kinds = ", ".join(
        f"({at}, {text(kind)}, {text(search)}, {least}, {10**9 if most is None else most}, {secret}, {weak})"
        for at, (kind, search, least, most, secret, weak) in enumerate(KINDS)
    )
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
kinds AS (SELECT * FROM (VALUES {kinds}) AS k(kind, name, search, least, most, secret, weak)),
found AS ({found}),
rows_ AS (SELECT r, search, unnest(gaps[:len(ns)]) AS gap, unnest(ns) AS n, unnest(vals) AS val, generate_subscripts(ns, 1) AS i FROM found),
placed AS (SELECT r, search, val, n, (sum(gap + n) OVER (PARTITION BY r, search ORDER BY i))::BIGINT AS stop FROM rows_),
parts AS (
  SELECT p.r, k.kind, k.name, k.secret, k.weak, p.stop - p.n AS start, p.stop,
    (SELECT count(*) FROM placed b WHERE b.r = p.r AND b.search = 'break' AND b.stop - b.n <= p.stop - p.n) AS scope
  FROM placed p JOIN kinds k ON k.search = p.search AND p.val BETWEEN k.least AND k.most),
reported AS (
  SELECT * FROM parts p
  WHERE NOT weak OR EXISTS (SELECT 1 FROM parts o WHERE o.r = p.r AND o.scope = p.scope AND o.secret <> p.secret
                            AND o.start BETWEEN p.start - {REACH} AND p.start + {REACH})),
joined AS (
  SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (kind < {BASE}) AS base,
    string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS spans
  FROM reported GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN joined USING (r)
"""


SQL = _sql()
