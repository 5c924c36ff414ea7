import datetime

import pytest
from pyspark.sql import functions as F

from lexitag.operators import clean
from lexitag.plans import flows
from lexitag.sources import report, store, tables

LINES = [
    "|  2021|12345 |60010 |Buero |05.03.2021 |  1.234,56-|Papier Größe A4 |Auftrag 7 |Partner X |  |4500012 |7000 |RB77 |",
    "|12345 |678 |0 |17.08.2020|Monitor 27 | 2.500,00 |EUR |Monitor lang |1234567 |900 |",
    "|1234567 |0 |7654321 |678 |17.08.2020|Monitor 27 | 2.500,00 |EUR |Monitor lang |900 |",
    "|KST 1 |12345 |Fonds A |555 |V 9 |02.01.2022|  99,90-|Kreditor Z |Maus USB |kurz |bez |8800 |  1|54 |Ist |Fipos |RW1 |",
    "|  2021|12A45 |60010 |Buero |05.03.2021 |  1,00 |a |b |c |  |1 |2 |d |",
    "Summe          1.234,56",
    "",
]
ROWS = [
    ("Anlagen", "12345", "MAUS USB", "", -99.9, datetime.date(2022, 1, 2), "2022", "8800"),
    ("Anlagen", "12345", "MONITOR 27", "", 2500.0, datetime.date(2020, 8, 17), "2020", "1234567"),
    ("Anlagen", "7654321", "MONITOR 27", "", 2500.0, datetime.date(2020, 8, 17), "2020", "1234567"),
    ("Kosten", "12345", "PAPIER GRÖSSE A4 AUFTRAG 7", "60010", -1234.56, datetime.date(2021, 3, 5), "2021", "4500012"),
]


@pytest.fixture
def report_file(tmp_path):
    path = tmp_path / "report.txt"
    path.write_bytes("\r\n".join(LINES).encode("latin-1"))
    return str(path)


def test_report_rows(spark, report_file, tmp_path):
    rows = flows.convert_report(spark, report_file, str(tmp_path / "out"))
    assert sorted(tuple(r) for r in rows.collect()) == ROWS
    back = spark.read.option("sep", ";").option("header", True).csv(str(tmp_path / "out"))
    assert back.columns == report.COLUMNS["current"] and back.count() == 4


def test_report_needs_no_shuffle(spark, report_file):
    plan = report.read_report(spark, report_file)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_legacy_report(spark, tmp_path):
    path = tmp_path / "r.txt"
    path.write_text(LINES[0].replace("|  2021|", "|2021  |") + "\n" + LINES[0] + "\n", "latin-1")
    rows = report.read_report(spark, str(path), "legacy").collect()
    assert len(rows) == 1
    assert (rows[0]["Tag"], rows[0]["Beschaffungsklasse"], rows[0]["CKA"]) == ("", "b", "")


def test_report_last_field_may_be_the_line_break(spark):
    line = "|  2021|1 |2 |x |05.03.2021 |1,00 |a |b |c |  |3 |4 |"
    df = spark.createDataFrame([(line,), (line + "\n",)], "line string")
    assert report.parse_report(df).count() == 1


def test_line_of_two_kinds(spark):
    kinds = report.kinds()
    assert len(kinds) == 4 and len({k.pattern for k in kinds}) == 4


def test_report_filters(spark, report_file):
    excludes = spark.createDataFrame([("12345", None), (None, "MONITOR 27")], "Kostenstelle string, Text string")
    assert flows.convert_report(spark, report_file, excludes=excludes).count() == 0
    learn = spark.createDataFrame([("1234567",), ("7654321",)], "Kostenstelle string")
    left = flows.convert_report(spark, report_file, learn=learn)
    assert [r["Kostenstelle"] for r in left.collect()] == ["7654321"]


def test_exclude_patterns(spark):
    df = spark.createDataFrame(
        [("1", "ABC"), ("2", "abc"), ("3", None), ("4", "xyz")], "Num string, Dext string"
    )
    kept = clean.exclude_patterns(df, {"Dext": ["a.c", ""], "Other": ["x"], "Num": ["4"]})
    # patterns are upper-cased, cells are not; a missing cell goes
    assert [r["Num"] for r in kept.collect()] == ["2"]


def test_many_patterns_are_one_filter(spark):
    df = spark.createDataFrame([(f"C{i}", "x") for i in range(6_000)], "a string, `b``c` string")
    many = [f"^c{i}$" for i in range(5_000)]
    kept = clean.exclude_patterns(df, {"a": many, "b`c": ["^Y"]})
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 2
    assert sorted(r["a"] for r in kept.collect()) == sorted(f"C{i}" for i in range(5_000, 6_000))
    # groups by number, quotes and flags keep their meaning beside others
    df = spark.createDataFrame([("AA",), ("AB",), ("X.Y",), ("XZY",), ("BCBC",), ("q",)], "a string")
    odd = {"a": ["(z)(z)", r"^(a)\1$", r"\Qx.y", "(BC)+$"]}
    assert sorted(r["a"] for r in clean.exclude_patterns(df, odd).collect()) == ["AB", "XZY", "q"]


def test_own_kinds_of_report_lines(spark):
    own = report.Kind("Reise", r"\|R(\d+)\|(\d{2}\.\d{2}\.(\d{4}))\|([\d\.]+,\d{2})\|([^\|]+)\|(\w+)", 1, (5,), 4, 2, 3, 6)
    lines = spark.createDataFrame([("|R77|01.02.2021|1.200,50|Zug Bonn|A9|",), (LINES[1],)], "line string")
    got = [tuple(r) for r in report.parse_report(lines, [own]).collect()]
    assert got == [("Reise", "77", "ZUG BONN", "", 1200.5, datetime.date(2021, 2, 1), "2021", "A9")]
    both = report.parse_report(lines, [own, *report.kinds()])
    assert sorted(r["Art"] for r in both.collect()) == ["Anlagen", "Reise"]


def test_line_breaks_in_cells_through_all_flows(spark, tmp_path):
    (tmp_path / "learn.csv").write_text('Num;Dext;Cat\n1;"paper\na4";office\n2;laptop;it\n')
    (tmp_path / "new.csv").write_text('Num;Dext;Cat\n9;"new\nlaptop";\n')
    folder = str(tmp_path / "model")
    model = flows.train_from_files(
        spark, str(tmp_path / "learn.csv"), folder, ["Cat"], multi_line=True, tokenizer="cell", keep_empty=False
    )
    assert sorted(r["word"] for r in model.weights.collect()) == ["1", "2", "laptop", "paper\na4"]
    _, tagged = flows.tag_files(spark, str(tmp_path / "new.csv"), folder, multi_line=True)
    assert [(r["Num"], r["Dext"]) for r in tagged.collect()] == [("9", "new\nlaptop")]
    (tmp_path / "dec.csv").write_text('Date;Text;Amount\n31.12.2020;"a\nb";1,5\n')
    got = tables.read_decimal_table(spark, str(tmp_path / "dec.csv"), ["Amount"], multi_line=True).first()
    assert (got["Text"], got["Amount"]) == ("a\nb", 1.5)


def test_read_table(spark, tmp_path):
    (tmp_path / "a1.csv").write_text("Num;Dext;TB_edit;TB_qual\n007;Royal;y;100\n007;Royal;y;100\n1;;y;3\n")
    (tmp_path / "a2.csv").write_text("Num;Dext;TB_edit;TB_qual\n9;Pay;y;1\n")
    (tmp_path / "b.csv").write_text("Num;Extra\n5;e\n")
    glob = str(tmp_path / "a*.csv")
    rows = sorted(tuple(r) for r in tables.read_table(spark, glob).collect())
    assert rows == [("007", "Royal"), ("007", "Royal"), ("1", "nan"), ("9", "Pay")]
    assert tables.read_table(spark, glob, distinct=True).count() == 3
    both = tables.read_table(spark, [glob, str(tmp_path / "b.csv")])
    assert both.columns == ["Num", "Dext", "Extra"]
    assert both.where("Extra = 'e' and Dext = 'nan'").count() == 1


def test_headers_in_another_order(spark, tmp_path):
    (tmp_path / "m1.csv").write_text("A;B\na1;b1\n")
    (tmp_path / "m2.csv").write_text("B;A\nb2;a2\n")
    (tmp_path / "m3.csv").write_text("A;C\na3;c3\n")
    got = tables.read_raw(spark, str(tmp_path / "m*.csv"))
    assert sorted((r["A"], r["B"], r["C"]) for r in got.collect()) == [
        ("a1", "b1", None),
        ("a2", "b2", None),
        ("a3", None, "c3"),
    ]


def test_quoted_cells(spark, tmp_path):
    cells = ['x "q" y', "back\\", "semi;colon", 'all "of\\";it', "two\nlines"]
    df = spark.createDataFrame([(str(i), c) for i, c in enumerate(cells)], "n string, c string")
    tables.write_table(df, str(tmp_path / "out"))
    got = tables.read_raw(spark, str(tmp_path / "out"), multi_line=True)
    assert sorted((r["n"], r["c"]) for r in got.collect()) == [(str(i), c) for i, c in enumerate(cells)]
    (tmp_path / "q.csv").write_text('A;B\n"x ""q"" y";"back\\"\n')
    assert tables.read_raw(spark, str(tmp_path / "q.csv")).first() == ('x "q" y', "back\\")


def test_exclude_lists(spark, tmp_path):
    (tmp_path / "x.lst").write_text("Num;Dext\n511140;Royalties\n;Pay Differential\n")
    assert tables.read_excludes(spark, str(tmp_path / "x.lst")) == {
        "Num": ["511140"],
        "Dext": ["ROYALTIES", "PAY DIFFERENTIAL"],
    }
    (tmp_path / "v.lst").write_text('Account Kind\n"Car Lease" a\nx b\n')
    values = tables.read_exclude_values(spark, str(tmp_path / "v.lst"))
    assert [tuple(r) for r in values.collect()] == [("Car Lease", "a"), ("x", "b")]
    assert tables.read_exclude_values(spark, str(tmp_path / "none.lst")) is None
    df = spark.createDataFrame(
        [(1, "Car Lease", "c"), (2, "y", "b"), (3, "y", "c"), (4, None, "c")], "id long, Account string, Kind string"
    )
    # every exclude column acts, not only the last one
    assert sorted(r["id"] for r in clean.exclude_values(df, values, "id").collect()) == [3, 4]


def test_decimal_table(spark, tmp_path):
    (tmp_path / "d1.csv").write_text("Date;Amount;Text\n31.12.2020;1,5;a\n")
    (tmp_path / "d2.csv").write_text("Date;Amount;Text\n01.02.2021;-2,25;b\n")
    df = tables.read_decimal_table(spark, str(tmp_path / "d*.csv"), ["Amount"])
    assert df.columns == ["Tag", "Date", "Amount", "Text"]
    assert sorted((r["Tag"], str(r["Date"]), r["Amount"]) for r in df.collect()) == [
        ("", "2020-12-31", 1.5),
        ("", "2021-02-01", -2.25),
    ]


def test_learn_table(spark):
    df = spark.createDataFrame([("t", None, 1, "z")], "cat string, words string, n int, extra string")
    learn = tables.as_learn_table(df, "cat", "words", columns=["cat", "words", "n"])
    assert learn.columns == ["Tag", "Text", "n"] and learn.first() == ("t", "None", 1)
    rows = spark.createDataFrame(
        [("a", "b", "c", ""), ("a", "None", "", None), ("a", "b", None, "")], "w string, x string, y string, z string"
    )
    kept = clean.none_cells_to_empty(clean.drop_sparse_rows(rows))
    assert [tuple(r) for r in kept.collect()] == [("a", "b", "c", "")]


def test_generated_keys_stay(spark):
    df = tables.with_entry(spark.range(1000).select(F.col("id").alias("v")).repartition(7))
    assert df.select("entry").distinct().count() == 1000
    assert df.join(df.withColumnRenamed("v", "w"), "entry").where("v <> w").count() == 0


def test_train_and_tag_files(spark, tmp_path):
    (tmp_path / "learn1.csv").write_text("Num;Dext;Cat\n1;paper a4;office\n2;laptop pro;it\n2;laptop pro;it\n")
    (tmp_path / "learn2.csv").write_text("Num;Dext;Cat\n3;paper a3;office\n4;Royalties;none\n")
    (tmp_path / "input.csv").write_text("Num;Dext;Cat\n1;PAPER A4;OFFICE\n8;laptop;\n9;papre box;\n5;zz;\n")
    folder = str(tmp_path / "model")
    glob = str(tmp_path / "learn*.csv")
    excludes = {"Dext": ["^R.*"]}
    model = flows.train_from_files(spark, glob, folder, ["Cat"], excludes, with_words=True)
    learn = store.load_table(spark, folder, store.LEARN)
    assert learn.count() == 3 and store.has_table(spark, folder, store.WORDS)
    assert not store.has_table(spark, folder, "absent")
    loaded = flows.load_model(spark, folder)
    assert (loaded.columns, loaded.tag_cols) == (model.columns, ["Cat"]) == (["Num", "Dext", "Cat"], ["Cat"])

    old, tagged = flows.tag_files(spark, str(tmp_path / "input.csv"), folder)
    assert [(r["Num"], r["Dext"], r["TB_edit"], r["TB_qual"]) for r in old.collect()] == [("1", "paper a4", "OLD", 100)]
    got = {r["Num"]: (r["Cat"], r["TB_qual"]) for r in tagged.collect()}
    # 'paper' is unique for office; 'papre' is only similar to it: 2 * 4 / 10
    assert got == {"8": ("it", 100), "9": ("office", 80), "5": (None, 0)}

    tables.write_results(tagged, str(tmp_path / "results"), loaded.columns, "entry")
    bands = {r["Num"]: (r["TB_edit"], r["quality_band"]) for r in spark.read.parquet(str(tmp_path / "results")).collect()}
    assert bands == {"8": ("y", None), "9": ("y", "yellow"), "5": ("y", "red")}

    def files(name):
        return sorted(p.name for p in (tmp_path / "model" / name).glob("part-*"))

    # stored tables are used again while nothing has changed, unless a rebuild is asked for
    before = {name: files(name) for name in (store.LEARN, store.WEIGHTS, store.UNIQUE)}
    flows.train_from_files(spark, glob, folder, ["Cat"], excludes)
    assert before == {name: files(name) for name in before}
    flows.train_from_files(spark, glob, folder, ["Cat"], excludes, rebuild=True)
    assert all(before[name] != files(name) for name in before)
    # a table that was left half-written is not read, the whole ones before it are
    before = {name: files(name) for name in before}
    (tmp_path / "model" / "_made" / store.WEIGHTS).unlink()
    flows.train_from_files(spark, glob, folder, ["Cat"], excludes)
    assert before[store.LEARN] == files(store.LEARN) and before[store.WEIGHTS] != files(store.WEIGHTS)
    # other settings and other files make other tables
    learn = files(store.LEARN)
    flows.train_from_files(spark, glob, folder, ["Num"], excludes)
    assert learn == files(store.LEARN)
    assert store.load_table(spark, folder, store.WEIGHTS).where("tag_col = 'Num'").count() > 0
    (tmp_path / "learn3.csv").write_text("Num;Dext;Cat\n7;chair;office\n")
    model = flows.train_from_files(spark, glob, folder, ["Cat"], excludes)
    assert store.load_table(spark, folder, store.LEARN).count() == 4
    assert model.unique.where("word = 'chair'").count() == 1
    with pytest.raises(ValueError):
        flows.train_from_files(spark, glob, folder, ["Missing"])


def test_result_dates(spark):
    df = spark.sql("select timestamp'2020-01-02 03:04:05' as d, 50 as TB_qual")
    row = clean.result_columns(df, ["d"]).first()
    assert (str(row["d"]), row["TB_edit"], row["quality_band"]) == ("2020-01-02", "y", "yellow")
