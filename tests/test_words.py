import pytest
from pyspark.sql import functions as F

from lexitag.functions import text as tx
from lexitag.functions.quality import quality_band
from lexitag.operators import clean, lookup, words
from lexitag.operators import model as md
from lexitag.operators.lasting import keep


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "c string").select(column(F.col("c")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "cell, row, per_cell",
    [
        ("Paper,A4: box", ["paper", "a4", "box"], ["paper", "a4", "box"]),
        (" a,b ", ["", "a", "b", ""], ["", "a", "b", ""]),
        ("1.234,56", ["1.234", "56"], ["1.234,56"]),
        ("v1.2 kit", ["v1.2", "kit"], ["v1", "2", "kit"]),
        ("line\nbreak", ["line\nbreak"], ["line\nbreak"]),
        ("", [""], [""]),
    ],
)
def test_split(spark, cell, row, per_cell):
    assert one(spark, cell, tx.row_words) == row
    assert one(spark, cell, tx.cell_words) == per_cell


def test_number_shape(spark):
    for value in ("12", "-1.5", "1,2,3", "٣"):
        assert one(spark, value, tx.is_number)
    for value in ("", "-", "1-", "1 2", "12\n"):
        assert not one(spark, value, tx.is_number)


def test_space_words(spark):
    assert one(spark, " a b\tNone c\x1cd ", tx.space_words) == ["a", "b", "c", "d"]
    assert one(spark, "   ", tx.space_words) == []


def test_spaces_are_what_python_strips(spark):
    import sys

    found = {chr(i) for i in range(sys.maxunicode) if chr(i).isspace()}
    assert set(tx.SPACES) == found
    assert one(spark, "  x y\x1f\n", tx.strip) == "x y"


def test_full_row_text(spark):
    df = spark.createDataFrame([("", "", "a", "", "b")], "a string, b string, c string, d string, e string")
    assert df.select(tx.full_row_text(df.columns)).first()[0] == "a  b"


def test_missing_cells_become_words(spark):
    df = spark.createDataFrame([(1, None, 2.5)], "id long, a string, b double")
    assert tx.stringify(df, keep=["id"]).first() == (1, "nan", "2.5")
    assert tx.stringify(df, missing=None).first() == ("1", None, "2.5")


def test_amount_and_day(spark):
    cases = {"1.234,56-": -1234.56, " 99,90": 99.9, "2.500,00 ": 2500.0, "x": None}
    for cell, value in cases.items():
        assert one(spark, cell, tx.amount) == value
    assert str(one(spark, "05.03.2021", tx.day)) == "2021-03-05"
    assert one(spark, "31.02.2021", tx.day) is None


def test_collapse_spaces(spark):
    assert one(spark, "a   b  c d", tx.collapse_spaces) == "abc d"
    assert one(spark, "a    b", tx.collapse_spaces) == "a b"


@pytest.mark.parametrize(
    "value, current, legacy",
    [(0, "red", "red"), (1, None, None), (19, "red", None), (20, "yellow", None), (89, "yellow", None),
     (90, None, None), (100, None, None), (0.5, "yellow", "red"), (0.7, "yellow", "yellow")],
)
def test_bands(spark, value, current, legacy):
    df = spark.createDataFrame([(float(value),)], "q double")
    assert df.select(quality_band(F.col("q"))).first()[0] == current
    assert df.select(quality_band(F.col("q"), "legacy")).first()[0] == legacy


GOLDEN = [("a", "t", "w", 10), ("b", "t", "w", 1), ("c", "t", "w", 3), ("a", "t", "x", 4),
          ("b", "t", "x", 4), ("a", "t", "y", 2)]


@pytest.fixture(scope="module")
def golden(spark):
    return spark.createDataFrame(GOLDEN, "tag string, tag_col string, word string, count long")


def test_probabilities(golden):
    got = {(r["tag"], r["word"]): r["probability"] for r in md.probabilities(golden, ["t"]).collect()}
    assert got == {("a", "w"): 100, ("b", "w"): 25, ("c", "w"): 75, ("a", "x"): 100,
                   ("b", "x"): 100, ("a", "y"): 100}


def test_vocabularies(golden):
    rated = md.rate_words(golden, ["t"])
    assert [(r["tag"], r["word"]) for r in md.unique_words(rated).collect()] == [("a", "y")]
    multi = sorted((r["tag"], r["word"]) for r in md.multi_words(rated).collect())
    assert multi == [("b", "w"), ("b", "x"), ("c", "w")]
    assert {r["word"]: r["count"] for r in md.ambiguous_words(rated).collect()} == {"w": 3, "x": 2}


def plain_probabilities(rows):
    """The rule row by row: first row of a word 100, later rows by their share if two or more."""
    rows = sorted(rows)
    out = {r: 100 for r in rows}
    for word in {r[2] for r in rows}:
        later = [r for r in rows if r[2] == word][1:]
        if len(later) < 2:
            continue
        total = sum(r[3] for r in later)
        seen = set()
        for r in later:
            if r[0] not in seen:
                seen.add(r[0])
                out[r] = round(r[3] / total * 100)
    return out


def test_probabilities_with_shared_tag_names(spark):
    import random

    random.seed(5)
    keys = {(random.choice("abcd"), random.choice("pqr"), random.choice("uvwxyz")) for _ in range(60)}
    rows = [(*k, random.randint(1, 9)) for k in sorted(keys)]
    df = spark.createDataFrame(rows, "tag string, tag_col string, word string, count long")
    got = {(r["tag"], r["tag_col"], r["word"], r["count"]): r["probability"] for r in md.probabilities(df, ["p", "q", "r"]).collect()}
    assert got == plain_probabilities(rows)


def test_weights_properties(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_name", "p_type", "p_brand")
    tags = ["p_type", "p_brand"]
    table = words.word_table(part, "p_partkey", tags)
    direct = md.weights(part, "p_partkey", tags)
    tokens = part.select(F.sum(F.size(tx.row_words(F.col("p_name"))))).first()[0]
    assert direct.agg(F.sum("count")).first()[0] == tokens * len(tags)
    columns = ["tag", "tag_col", "word", "count"]
    stored = md.weights_of_words(table).select(columns)
    assert sorted(direct.select(columns).collect()) == sorted(stored.collect())
    rated = md.rate_words(direct, tags)
    unique = md.unique_words(rated).select("word", "tag_col")
    assert unique.join(md.multi_words(rated), ["word", "tag_col"]).count() == 0


def test_cell_tokenizer_and_empty_words(spark):
    df = spark.createDataFrame([(1, "v1.2 ", "1.5", "t")], "id long, a string, b string, tag string")
    got = {r["word"]: r["count"] for r in md.weights(df, "id", ["tag"], "cell").collect()}
    assert got == {"v1": 1, "2": 1, "": 1, "1.5": 1}
    got = {r["word"] for r in md.weights(df, "id", ["tag"], "cell", keep_empty=False).collect()}
    assert "" not in got


def test_missing_tag_column(spark):
    df = spark.createDataFrame([(1, "x")], "id long, a string")
    with pytest.raises(ValueError):
        md.weights(df, "id", ["tag"])


def test_distinct_rows_keep_smallest_key(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b")], "id long, a string")
    assert sorted(clean.distinct_rows(df, "id").collect()) == [(1, "a"), (2, "b")]


def test_words_are_rated_in_one_shuffle(spark, sf, monkeypatch):
    """Few tags: windows over the rows of a word. As many as make a hot key: the same by aggregates."""
    documents = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source")
    shared = documents.selectExpr("doc_id", "text", "lang", "if(doc_id % 2 = 0, lang, source) as source")
    for learn in (documents, shared):
        weights = keep(md.weights(learn, "doc_id", ["lang", "source"]))
        rated = md.rate_words(weights, ["lang", "source"])
        plan = rated._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
        found = sorted(map(str, rated.collect()))
        with monkeypatch.context() as patch:
            patch.setattr(lookup, "HOT_ROWS", 0)
            many = md.rate_words(weights, ["lang", "source"])
            assert "Join" in many._jdf.queryExecution().executedPlan().toString()
            assert sorted(map(str, many.collect())) == found
