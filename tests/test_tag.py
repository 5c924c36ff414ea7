import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lexitag.functions.ratio import Block, best_matches
from lexitag.operators import lookup, similar
from lexitag.operators.existing import split_existing
from lexitag.operators.lasting import keep
from lexitag.operators.model import TagModel, multi_words, rate_words, train, unique_words
from lexitag.operators.tag import similar_stage, tag_rows
from test_words import GOLDEN


def golden_model(spark):
    weights = spark.createDataFrame(GOLDEN, "tag string, tag_col string, word string, count long")
    rated = rate_words(weights, ["t"])
    return TagModel(["text", "t"], ["t"], weights, rated, unique_words(rated), multi_words(rated))


def test_golden_tagging(spark):
    new = spark.createDataFrame(
        [(1, "Y; w", ""), (2, "w", ""), (3, "w,x", ""), (4, "qq", "")], "id long, text string, t string"
    )
    got = {r["id"]: (r["t"], r["TB_qual"]) for r in tag_rows(new, golden_model(spark), "id").collect()}
    assert got == {1: ("a", 100), 2: ("b", 75), 3: ("c", 100), 4: (None, 0)}


def test_null_and_repeated_row_keys(spark):
    new = spark.createDataFrame(
        [(None, "Y; w", ""), (None, "w", ""), (5, "w", ""), (5, "w,x", ""), (5, "w,x", ""), (None, "qq", "")],
        "id long, text string, t string",
    )
    got = sorted((str(r["id"]), r["text"], str(r["t"]), r["TB_qual"]) for r in tag_rows(new, golden_model(spark), "id").collect())
    assert got == sorted(
        [("None", "Y; w", "a", 100), ("None", "w", "b", 75), ("5", "w", "b", 75), ("5", "w,x", "c", 100)]
        + [("5", "w,x", "c", 100), ("None", "qq", "None", 0)]
    )


def test_names_do_not_clash(spark):
    """Input columns called like computed ones, or with a backtick, dot or blank in their names."""
    odd = ["entry", "tags", "qual", "_tags", "_qual", "word", "in_0", "a`b", "a.b", "a b", "_row", "_known"]
    learn = spark.createDataFrame(
        [(1, "alpha", "p", *["c"] * len(odd)), (2, "beta", "q", *["c"] * len(odd))], ["id", "text", "t", *odd]
    )
    new = spark.createDataFrame([(7, "Beta", "", *["c"] * len(odd)), (8, "ALPHA", "p", *["C"] * len(odd))], learn.schema)
    old, rest = split_existing(new, learn, "id")
    assert [(r["id"], r["text"], r["a`b"], r["TB_qual"]) for r in old.collect()] == [(8, "alpha", "c", 100)]
    assert rest.columns == new.columns and [r["id"] for r in rest.collect()] == [7]
    model = train(learn, "id", ["t"])
    got = tag_rows(new, model, "id").collect()
    assert {(r["id"], r["t"], r["_tags"].lower(), r["a`b"].lower(), r["TB_qual"]) for r in got} == {
        (7, "q", "c", "c", 100),
        (8, "p", "c", "c", 100),
    }


def test_stages_shuffle_no_cells(spark, monkeypatch):
    """What the stages work on are keys and words; the cells are read for the result only."""
    from lexitag.operators import tag as module

    kept = []
    monkeypatch.setattr(module, "keep", lambda df: kept.append(df.columns) or keep(df))
    new = spark.createDataFrame([(1, "Y; w", "")], "id long, text string, t string")
    result = tag_rows(new, golden_model(spark), "id")
    assert kept and all("in_1" not in c for c in kept)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(in_" not in plan


def test_too_few_hits(spark):
    learn = spark.createDataFrame(
        [(1, "alpha", "p", "u"), (2, "alpha", "p", "v"), (3, "beta", "q", "v")],
        "id long, text string, s string, t string",
    )
    model = train(learn, "id", ["s", "t"])
    new = spark.createDataFrame([(9, "alpha", "", ""), (8, "beta", "", "")], learn.schema)
    got = {r["id"]: (r["s"], r["t"], r["TB_qual"]) for r in tag_rows(new, model, "id").collect()}
    # alpha is unique for s only: one hit for two tag columns; beta is unique for both
    assert got == {9: (None, None, 1), 8: ("q", "v", 100)}


def random_word(least, most):
    return "".join(random.choice("abcdeé") for _ in range(random.randint(least, most)))


def brute(token, words, count, least, inclusive, lengths):
    out = []
    for word in words:
        if lengths and not lengths[0] < len(word) / len(token) < lengths[1]:
            continue
        ratio = SequenceMatcher(None, word, token, autojunk=True).ratio()
        if ratio > least or (inclusive and ratio == least):
            out.append((ratio, word))
    return sorted(out, reverse=True)[:count]


@pytest.mark.parametrize("rule", [similar.WORDS, similar.TEXTS])
@pytest.mark.parametrize("count", [1, 3])
def test_best_matches(rule, count):
    random.seed(count)
    words = sorted({random_word(5, 26) for _ in range(300)} | {random_word(60, 90) for _ in range(20)})
    block = Block(words)
    for token in [random_word(5, 26) for _ in range(60)] + [random_word(60, 90) for _ in range(10)]:
        got = sorted(best_matches(token, block, count, **rule), reverse=True)
        assert got == brute(token, words, count, **rule)


def test_ratio_examples():
    def ratio(word, token):
        found = best_matches(token, Block([word]), 1, least=0.0, inclusive=True, lengths=None)
        return round(found[0][0], 4)

    assert ratio("invoice", "invoise") == 0.8571
    assert ratio("monitor", "motinor") == 0.7143
    assert ratio("paper", "pepar") == 0.6
    assert (ratio("tide", "diet"), ratio("diet", "tide")) == (0.25, 0.5)


def test_similar_words_over_cells(spark, monkeypatch):
    monkeypatch.setattr(similar, "PIECE", 20)
    monkeypatch.setattr(similar, "LEAST_PAIRS", 1)
    random.seed(11)
    words = sorted({random_word(3, 30) for _ in range(250)})
    tokens = sorted({random_word(3, 30) for _ in range(120)})
    asked = spark.createDataFrame([(t,) for t in tokens + tokens[:40]], "token string")
    offered = spark.createDataFrame([(w,) for w in words], "word string")
    got = {}
    for r in similar.similar_words(asked, offered, 2).collect():
        got.setdefault(r["token"], []).append((r["similarity"], r["word"]))
    long = [w for w in words if len(w) > 4]
    want = {t: brute(t, long, 2, **similar.WORDS) for t in tokens if len(t) > 4}
    assert {t: sorted(v, reverse=True) for t, v in got.items()} == {t: v for t, v in want.items() if v}


def test_pieces_are_passed_over(spark, monkeypatch):
    """Seeds let texts pass whole pieces over, by characters alone, and no match is lost."""
    monkeypatch.setattr(similar, "PIECE", 40)
    random.seed(21)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = sorted({"".join(random.choices(letters, k=10)) for _ in range(1500)})
    tokens = sorted({w[:i] + random.choice(letters) + w[i + 1 :] for w in words[::5] for i in (3,)})
    asked = spark.createDataFrame([(t,) for t in tokens], "token string")
    offered = spark.createDataFrame([(w,) for w in words], "word string")
    shares, whole = [], similar._seeded

    def seeded(reach, first, found, count):
        rest = whole(reach, first, found, count)
        shares.append(1 - rest.count() / (reach.count() - first.count()))
        return rest

    monkeypatch.setattr(similar, "_seeded", seeded)
    got = {r["token"]: [(r["similarity"], r["word"])] for r in similar.similar_words(asked, offered, 1).collect()}
    want = {t: brute(t, words, 1, **similar.WORDS) for t in tokens}
    assert got == {t: v for t, v in want.items() if v}
    assert shares[0] > 0.2  # 0.27 of all pieces but the first, of random letters


def test_long_texts_make_small_cells(spark, monkeypatch):
    monkeypatch.setattr(similar, "PIECE_BYTES", 2000)
    random.seed(22)
    words = [random_word(150, 400) for _ in range(30)] + ["", "x" * 3000]
    tokens = [w[: len(w) // 2] + random_word(10, 20) for w in words[:8]] + ["", "none"]
    asked = spark.createDataFrame([(t,) for t in tokens], "token string")
    offered = spark.createDataFrame([(w,) for w in words], "word string")
    got = {r["token"]: [(r["similarity"], r["word"])] for r in similar.best_text(asked, offered).collect()}
    want = {t: brute(t, words, 1, **similar.TEXTS) for t in tokens}
    assert got == {t: v for t, v in want.items() if v}


def test_best_text_over_cells(spark, monkeypatch):
    monkeypatch.setattr(similar, "PIECE", 20)
    random.seed(12)
    words = sorted({random_word(1, 60) for _ in range(150)})
    tokens = sorted({random_word(1, 60) for _ in range(80)})
    asked = spark.createDataFrame([(t,) for t in tokens], "token string")
    offered = spark.createDataFrame([(w,) for w in words], "word string")
    got = {r["token"]: [(r["similarity"], r["word"])] for r in similar.best_text(asked, offered).collect()}
    want = {t: brute(t, words, 1, **similar.TEXTS) for t in tokens}
    assert got == {t: v for t, v in want.items() if v}


def plain_similar_stage(words, vocabulary, tag_cols):
    """Rows (tag, tag_col, word) compared word by word in vocabulary order, then the rule."""
    found = []
    for token in words:
        for tag, tag_col, word in vocabulary:
            if len(token) > 4 and len(word) > 4 and 0.95 < len(word) / len(token) < 1.05:
                ratio = SequenceMatcher(None, word, token, autojunk=True).ratio()
                if ratio > 0.3:
                    found.append((ratio, word, tag, tag_col))
    found.sort(key=lambda r: (r[0], r[1]), reverse=True)  # stable: equal keys keep their order
    found = found[: len(tag_cols)]
    if not found:
        return None
    if len(found) < len(tag_cols):
        return {c: None for c in tag_cols}, 1
    tags = {c: None for c in tag_cols}
    for _, _, tag, tag_col in dict.fromkeys((0, 0, r[2], r[3]) for r in found):
        tags[tag_col] = tag
    return tags, int(found[0][0] * 100)


def test_similar_stage(spark):
    random.seed(13)
    tag_cols = ["s", "t"]
    keys = {(random_word(5, 8), random.choice(tag_cols)) for _ in range(80)}
    vocabulary = sorted((random.choice("pqr"), c, w) for w, c in keys)
    unique = spark.createDataFrame(vocabulary, "tag string, tag_col string, word string")
    rows = {i: [random_word(2, 9) for _ in range(random.randint(1, 4))] for i in range(60)}
    rows = {i: ws + ws[:1] for i, ws in rows.items()}  # a repeated word gives repeated candidates
    asked = spark.createDataFrame(list(rows.items()), "entry long, words array<string>")
    got = {}
    for r in similar_stage(asked, unique, tag_cols).collect():
        tags = r["tags"].asDict() if r["tags"] else {c: None for c in tag_cols}
        got[r["entry"]] = (tags, r["qual"])
    want = {i: plain_similar_stage(ws, sorted(vocabulary, key=lambda v: (v[0], v[1], v[2])), tag_cols)
            for i, ws in rows.items()}
    assert got == {i: v for i, v in want.items() if v}


def test_known_rows_are_found_once(spark, sf):
    """Copies of learn rows in other letter case come back as old rows, the rest as new rows."""
    customers = spark.read.parquet(f"{sf}/customer.parquet").select(
        F.col("c_custkey").alias("id"), "c_name", "c_mktsegment"
    )
    known = customers.where("id < 20").withColumns(
        {"id": F.col("id") + 10_000, "c_name": F.upper("c_name"), "c_mktsegment": F.lower("c_mktsegment")}
    )
    unknown = customers.withColumns({"id": F.col("id") + 20_000, "c_name": F.concat("c_name", F.lit("x"))})
    new = known.unionByName(unknown)
    old, rest = split_existing(new, customers, "id")
    old, rest = old.collect(), rest.collect()
    assert len(old) == 20 and {r["TB_qual"] for r in old} == {100} and {r["TB_edit"] for r in old} == {"OLD"}
    assert all(r["c_name"].startswith("Customer#") for r in old)
    assert len(rest) == unknown.count() and len(old) + len(rest) == new.count()


def test_unknown_input_column(spark):
    learn = spark.createDataFrame([(1, "x")], "id long, a string")
    with pytest.raises(ValueError):
        split_existing(learn.withColumn("b", F.lit("")), learn, "id")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_hot_keys_are_split(spark, monkeypatch, how):
    """One key holds most rows: the salted join has the rows of the plain join."""
    monkeypatch.setattr(lookup, "HOT_ROWS", 50)
    left = spark.range(2000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("3", 3), ("6", 4)], "k string, v int")
    hot = lookup.hot_keys(left, ["k"])
    assert len(hot) == 1 and hot[0][1] > 1000
    salted = lookup.salted_join(left, right, ["k"], how, ["id"])
    plain = left.join(right, "k", how)
    assert sorted(salted.select(plain.columns).collect(), key=str) == sorted(plain.collect(), key=str)


def test_tagging_with_salted_lookups(spark, sf, monkeypatch):
    """Beyond the broadcast limit and with split keys the tags are the same."""
    part = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_name", "p_type", "p_brand")
    model = train(part, "p_partkey", ["p_type", "p_brand"])
    new = part.withColumns({"p_type": F.lit(""), "p_brand": F.lit("")})
    small = sorted(tag_rows(new, model, "p_partkey").collect())
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(lookup, "fits_broadcast", lambda df: False)
    monkeypatch.setattr(lookup, "HOT_ROWS", 10)
    assert sorted(tag_rows(new, model, "p_partkey").collect()) == small


def test_every_new_row_once(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_name", "p_type")
    model = train(part, "p_partkey", ["p_type"])
    new = part.withColumn("p_type", F.lit(""))
    ids = [r["p_partkey"] for r in tag_rows(new, model, "p_partkey").collect()]
    assert len(ids) == len(set(ids)) == part.count()


def test_any_column_name(spark):
    schema = "id long, `Acct. Name` string, `Tag.1` string, `my tag` string"
    learn = spark.createDataFrame([(1, "alpha one", "p", "u"), (2, "beta two", "q", "v")], schema)
    model = train(learn, "id", ["Tag.1", "my tag"])
    new = spark.createDataFrame([(8, "ALPHA ONE", "P", "U"), (9, "beta x", "", "")], schema)
    old, rest = split_existing(new, learn, "id")
    assert [tuple(r) for r in old.collect()] == [(8, "alpha one", "p", "u", "OLD", 100)]
    assert [tuple(r) for r in tag_rows(rest, model, "id").collect()] == [(9, "beta x", "q", "v", 100)]


def test_kept_tables_can_be_forgotten(spark):
    from lexitag.operators import lasting

    df = lasting.keep(spark.range(3).select("id", (F.col("id") * 2).alias("`a.b`")))
    path = df.inputFiles()[0]
    lasting.forget(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(path)


def test_missing_cells_and_numbers(spark):
    schema = "id long, a string, n int, t string"
    learn = spark.createDataFrame([(1, "alpha", None, "p"), (2, "beta", 7, "q")], schema)
    model = train(learn, "id", ["t"])
    assert {r["word"] for r in model.unique.collect()} == {"alpha", "nan", "beta", "7"}
    new = spark.createDataFrame([(5, "ALPHA", None, "p"), (6, None, 7, None), (7, "x", 7, "")], schema)
    old, rest = split_existing(new, learn, "id")
    assert [tuple(r) for r in old.collect()] == [(5, "alpha", "nan", "p", "OLD", 100)]
    got = {r["id"]: (r["a"], r["n"], r["t"], r["TB_qual"]) for r in tag_rows(rest, model, "id").collect()}
    # a missing cell is the word 'nan', known here for p; with 7 for q the larger tag wins
    assert got == {6: ("nan", "7", "q", 100), 7: ("x", "7", "q", 100)}


def test_copies_of_one_row_are_split(spark, monkeypatch):
    """A third and more of the input are copies of one known row, another third of one new row."""
    monkeypatch.setattr(lookup, "HOT_ROWS", 100)
    learn = spark.createDataFrame([(1, "known"), (2, "Known"), (3, "other")], "id long, a string")
    ids = spark.range(3000)
    text = F.when(F.col("id") % 3 == 0, "KNOWN").when(F.col("id") % 3 == 1, "new")
    new = ids.select("id", F.coalesce(text, F.concat(F.lit("w"), F.col("id").cast("string"))).alias("a"))
    assert len(lookup.hot_keys(new, ["a"])) == 2
    old, rest = split_existing(new, learn, "id")
    old = old.collect()
    assert len(old) == 1000 and {r["a"] for r in old} == {"known"}
    assert rest.count() == 2000 and rest.where("a = 'new'").count() == 1000


def test_checkpoint_folder_must_be_shared():
    from types import SimpleNamespace

    from lexitag.operators.lasting import checkpoint_folder

    folders = []

    def session(master, setting):
        context = SimpleNamespace(
            master=master,
            getCheckpointDir=lambda: folders[-1] if folders else None,
            setCheckpointDir=folders.append,
        )
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, other: setting))

    with pytest.raises(RuntimeError):
        checkpoint_folder(session("yarn", None))
    assert checkpoint_folder(session("yarn", "hdfs:///shared")) == "hdfs:///shared"
    folders.clear()
    assert "lexitag-" in checkpoint_folder(session("local[2]", None))


def _kept(monkeypatch, *modules):
    """What the modules keep from here on: (columns, rows)."""
    kept = []

    def noted(df):
        kept.append((df.columns, (table := keep(df)).collect()))
        return table

    for module in modules:
        monkeypatch.setattr(module, "keep", noted)
    return kept


def test_words_are_sifted_before_they_are_shuffled(spark, monkeypatch):
    """Words no vocabulary holds, and the words of decided rows, are neither written nor shuffled."""
    from lexitag.operators import tag as module

    new = spark.createDataFrame(
        [(i, f"other{i} words{i}, none{i}" + ("; Y" if i % 10 else "; w"), "") for i in range(200)],
        "id long, text string, t string",
    )
    wanted = sorted(map(str, tag_rows(new, golden_model(spark), "id").collect()))
    monkeypatch.setattr(lookup, "fits_broadcast", lambda df: False)
    kept = _kept(monkeypatch, module, lookup)
    got = tag_rows(new, golden_model(spark), "id", ("unique", "multi", "similar"))
    assert sorted(map(str, got.collect())) == wanted
    occurrences = [rows for columns, rows in kept if columns == ["entry", "word"]]
    assert occurrences and all(len(rows) <= 200 + 5 for rows in occurrences)
    assert all(len(rows) <= 20 for columns, rows in kept if "words" in columns)


@pytest.mark.parametrize("how", ["inner", "left_semi"])
def test_sift_loses_no_partner(spark, how):
    left = spark.range(20000).selectExpr("id", "if(id % 100 = 0, null, concat('w', id)) as k", "id % 7 as `a b`")
    right = spark.range(0, 20000, 9).selectExpr("concat('w', id) as k", "id as v")
    some = lookup.sifted(left, right, ["k"])
    assert some.columns == left.columns and some.count() < 2400
    rows = lambda df: sorted(map(str, df.join(right, "k", how).collect()))
    assert rows(some) == rows(left)
    assert lookup.sifted(left, right.where("v < 0"), ["k"]).count() == 0


def test_only_words_within_reach_get_bit_sets(spark, monkeypatch):
    words = spark.createDataFrame([("x" * n + chr(97 + i),) for n in range(4, 40) for i in range(20)], ["word"])
    tokens = spark.createDataFrame([("xxxxxxxz",)], ["token"])
    kept = _kept(monkeypatch, similar)
    got = [tuple(r) for r in similar.similar_words(tokens, words, 2).collect()]
    assert got == [("xxxxxxxz", "xxxxxxxt", 0.875), ("xxxxxxxz", "xxxxxxxs", 0.875)]
    signed = [rows for columns, rows in kept if "word" in columns and "b0" in columns]
    assert len(signed) == 1 and len(signed[0]) == 20
    similar.similar_words(tokens.where("false"), words, 2).collect()
    assert [len(rows) for columns, rows in kept if "word" in columns and "b0" in columns] == [20, 0]
