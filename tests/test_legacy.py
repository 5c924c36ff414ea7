import random
from difflib import SequenceMatcher, get_close_matches

from lexitag.operators import legacy, ngrams, profile
from lexitag.operators.existing import split_existing_normalised
from lexitag.plans import flows
from lexitag.registry import inputs, tagging

LEARN = [
    (1, "y", "GYM FEE", "g1", "A"),
    (2, "y", "GYM BALL", "g1", "A"),
    (3, "it", "LAPTOP FEE", "g2", "B"),
    (4, "it", "MONITOR DELL", "g2", "B"),
    (5, "paper", "BOX DELL SHEETS", "g3", "C"),
    (6, "paper", "SHEETS BLUE", "g3", "C"),
    (7, "pens", "INK RED", "g4", "D"),
]
SCHEMA = "id long, Tag string, Text string, grp string, loc string"


def rows(spark, data, schema=SCHEMA):
    return spark.createDataFrame(data, schema)


def new_rows(spark, *texts):
    return rows(spark, [(i, "", t, "", "") for i, t in enumerate(texts)])


def vocabularies(spark):
    learn = rows(spark, LEARN)
    from lexitag.operators.clean import relabel_relevance

    usable, unclear = ngrams.relevance_ngrams(relabel_relevance(learn, "y"))
    return learn, usable, unclear


def test_relevance_words(spark):
    _, usable, unclear = vocabularies(spark)
    got = {r["Ngram"]: (r["ngramTag"], r["size"]) for r in usable.collect()}
    assert got["GYM"] == ("not_relevant", 2) and got["DELL"] == ("relevant", 2)
    assert {r["Ngram"] for r in unclear.collect()} == {"FEE"}


def test_tag_words_occur_once(spark):
    learn, _, unclear = vocabularies(spark)
    got = {r["Ngram"]: r["ngramTag"] for r in ngrams.tag_ngrams(learn, unclear).collect()}
    assert got == {"LAPTOP": "it", "MONITOR": "it", "BOX": "paper", "BLUE": "paper", "INK": "pens", "RED": "pens"}


def test_tag_relevance(spark):
    _, usable, _ = vocabularies(spark)
    new = new_rows(spark, "GYM x", "GYM DELL", "LAPTOP", "nothing", "gym")
    got = {r["id"]: (r["Tag"], r["Edit"], r["Quality"]) for r in legacy.tag_relevance(new, usable, "id").collect()}
    assert got == {0: ("y", "", 1.0), 1: ("", "NEW", 0.0), 2: ("", "", None), 3: ("", "", None), 4: ("", "", None)}


def test_tag_by_ngram_fills_empty_cells(spark):
    learn, _, unclear = vocabularies(spark)
    words = ngrams.tag_ngrams(learn, unclear)
    fill = profile.fill_values(learn, "Tag", ["grp", "loc"])
    new = rows(spark, [(0, "", "BLUE BOX", "", "own"), (1, "", "BLUE RED", "", ""), (2, "", "zz", "", "")])
    got = {r["id"]: tuple(r)[1:] for r in legacy.tag_by_ngram(new, words, "id", fill, ["grp", "loc"]).collect()}
    assert got[0] == ("paper", "BLUE BOX", "g3", "own", "", 1.0)
    assert got[1] == ("", "BLUE RED", "", "", "NEW", 0.0)
    assert got[2] == ("", "zz", "", "", "", None)


def test_fill_value_ties_take_the_smallest(spark):
    df = rows(spark, [(1, "t", "", "b", ""), (2, "t", "", "a", ""), (3, "t", "", "c", ""), (4, "t", "", "c", "x")])
    got = {(r["Col"], r["Tag"]): r["Val"] for r in profile.fill_values(df, "Tag", ["grp", "loc"]).collect()}
    assert got == {("grp", "t"): "c"}  # the mode of loc is empty: no value
    df = rows(spark, [(1, "t", "", "b", ""), (2, "t", "", "a", "")])
    assert profile.fill_values(df, "Tag", ["grp"]).first()["Val"] == "a"


def test_column_tags(spark):
    data = [(1, "A", "", "v", ""), (2, "A", "", "v  ", ""), (3, "B", "", "v", ""), (4, "B", "", "w", ""),
            (5, "B", "", "u", " "), (6, "B", "", "u", " "), (7, "A", "", "u", ""), (8, "A", "", "u", "")]
    got = [tuple(r) for r in profile.column_tags(rows(spark, data), "Tag", ["grp", "loc"]).collect()]
    # v is twice with A and once with B: the single one does not count; u has two tags
    assert got == [("grp", "v", "A")]


def test_tag_by_column(spark):
    tags = spark.createDataFrame([("grp", "g", "not_relevant"), ("loc", "l", "relevant")], "col string, val string, Tag string")
    new = rows(spark, [(1, "", "a", "g", ""), (2, "", "a", "l", "l"), (3, "", "a", "", "g")])
    got = {r["id"]: r["Tag"] for r in legacy.tag_by_column(new, tags, "id", ["grp", "loc"]).collect()}
    assert got == {1: "y", 2: "", 3: ""}


def test_existing_normalised(spark):
    learn = rows(spark, [(1, "it", "Lap Top", "a b", "None"), (2, "pc", "LAPTOP", "z", "q"), (3, "x", "pen", "", "")])
    new = rows(spark, [(10, "", "laptop", "", ""), (11, "", "p e n", "", ""), (12, "", "chair", "", "")])
    old, rest, conflicts = split_existing_normalised(new, learn, "id", ["Tag", "Text"], ["Tag", "grp", "loc"])
    got = {r["id"]: (r["Tag"], r["Text"], r["grp"], r["loc"], r["Edit"], r["Quality"]) for r in old.collect()}
    assert got == {10: ("it", "laptop", "ab", "", "OLD", 1.0), 11: ("x", "p e n", "", "", "OLD", 1.0)}
    assert [(r["id"], r["Edit"]) for r in rest.collect()] == [(12, "")]
    assert sorted(r["id"] for r in conflicts.collect()) == [1, 2]


def test_clean_and_verified_words(spark):
    data = [(i, "it", "bolt nut", "", "") for i in range(5)] + [(9, "car", "xboltx", "", "")]
    learn = rows(spark, data)
    kept = ngrams.clean_ngrams(ngrams.ngram_counts(learn))
    assert {r["Ngram"]: r["ngramTag"] for r in kept.collect()} == {"bolt": "it", "nut": "it"}
    # 'bolt' is part of a word in a row of another tag
    got = ngrams.verified_ngrams(kept, learn, "id").collect()
    assert sorted((r["id"], r["Ngram"]) for r in got) == [(i, "nut") for i in range(5)]


def test_words_inside_long_and_odd_tokens(spark):
    """Seeds and chunks find every word in every token, whatever their lengths."""
    rng = random.Random(31)
    letters = "abé東"
    tokens = ["".join(rng.choices(letters, k=rng.randrange(1, 40))) for _ in range(120)]
    long = "".join(rng.choices(letters, k=100_000))
    tokens += [long, "x" * 700, long[:300]]
    words = {t[i : i + n] for t in tokens[:40] for n in (1, 2, 3, 5, 8, 13, 17) for i in range(0, max(1, len(t) - n), 7)}
    words = sorted({*words, long[254:262], long[250:290], long[99_980:], long[:600], "x" * 699, "zz", "aaaaaaaaaaaaaaaaaaaaaaaaab"})
    asked = spark.createDataFrame([(t,) for t in sorted(set(tokens))], "token string")
    offered = spark.createDataFrame([(w, "t") for w in words], "Ngram string, ngramTag string")
    got = {(r["token"], r["Ngram"]) for r in ngrams._containing(asked, offered).collect()}
    assert got == {(t, w) for t in set(tokens) for w in words if w in t}


def plain_similar(entry, learn, variable):
    """Short text first; over 0.95 the joined texts of the filled variable columns as well."""
    short = entry["Text"].replace(" ", "")
    texts = [r["Text"].replace(" ", "") for r in learn]

    def best(text, options):
        match = get_close_matches(text, options, 1, 0.25)
        if not match:
            return None, 0.0
        ratio = SequenceMatcher(None, match[0], text, autojunk=True).ratio()
        return learn[options.index(match[0])]["Tag"], float(format(ratio, "0.02f"))

    tag, quality = best(short, texts)
    if quality > 0.95:
        cols = [c for c in variable if len(entry[c].replace(" ", "")) > 1]
        joined = ["".join(r[c] for c in cols).replace(" ", "") for r in learn]
        long_tag, long_quality = best("".join(entry[c] for c in cols).replace(" ", ""), joined)
        if long_quality > quality:
            tag, quality = long_tag, long_quality
    return tag or "", quality


def test_tag_similar(spark):
    import random

    random.seed(2)

    def word(n):
        return "".join(random.choice("abcd ") for _ in range(n)).strip() or "a"

    learn = [{"id": i, "Tag": f"t{i}", "Text": word(40), "grp": word(6), "loc": word(3)} for i in range(40)]
    new = []
    for i in range(50):
        source = random.choice(learn)
        text = source["Text"] if i % 2 else source["Text"][:-1] + "x" if i % 4 else word(12)
        new.append({"id": 100 + i, "Tag": "", "Text": text, "grp": source["grp"] if i % 3 else "", "loc": word(2)})
    variable = ["Text", "grp", "loc"]
    as_rows = [[(r["id"], r["Tag"], r["Text"], r["grp"], r["loc"]) for r in part] for part in (learn, new)]
    got = legacy.tag_similar(rows(spark, as_rows[1]), rows(spark, as_rows[0]), "id", [], variable)
    got = {r["id"]: (r["Tag"], r["Quality"]) for r in got.collect()}
    assert got == {r["id"]: plain_similar(r, learn, variable) for r in new}


ODD = ["_result", "_conflict", "_hit", "_ratio", "_taken", "key", "said", "clash", "kind", "token", "tag", "in_0", "a`b", "word"]


def odd_rows(spark, data):
    """Rows whose other columns bear names that the stages compute under, or a backtick."""
    extra = ", ".join("`" + c.replace("`", "``") + "` string" for c in ODD)
    return spark.createDataFrame([(*r, *(f"v{i}" for i in range(len(ODD)))) for r in data], f"{SCHEMA}, {extra}")


def test_any_column_names_null_and_repeated_keys(spark):
    learn, usable, unclear = vocabularies(spark)
    texts = ["GYM x", "BLUE BOX", "BLUE RED", "zz", None, "GYM x", "BLUE BOX"]
    keys = [1, None, 1, None, 7, 1, 1]
    new = odd_rows(spark, [(k, "", t, "", "own") for k, t in zip(keys, texts)])
    rated = legacy.tag_relevance(new, usable, "id")
    assert rated.columns == [*new.columns, "Edit", "Quality"]
    got = sorted((r["Text"] or "", r["Tag"]) for r in rated.collect())
    assert got == [("", ""), ("BLUE BOX", ""), ("BLUE BOX", ""), ("BLUE RED", ""), ("GYM x", "y"), ("GYM x", "y"), ("zz", "")]
    fill = profile.fill_values(learn, "Tag", ["grp", "loc"])
    named = legacy.tag_by_ngram(new, ngrams.tag_ngrams(learn, unclear), "id", fill, ["grp", "loc"])
    assert sorted((r["Text"], r["Tag"], r["grp"], r["loc"], r["Edit"]) for r in named.where("Text like 'BLUE%'").collect()) == [
        ("BLUE BOX", "paper", "g3", "own", ""),
        ("BLUE BOX", "paper", "g3", "own", ""),
        ("BLUE RED", "", "", "own", "NEW"),
    ]
    tags = spark.createDataFrame([("a`b", f"v{ODD.index('a`b')}", "not_relevant")], "col string, val string, Tag string")
    assert {r["Tag"] for r in legacy.tag_by_column(new, tags, "id", ["grp", "a`b"]).collect()} == {"y"}
    alike = legacy.tag_similar(new, odd_rows(spark, LEARN), "id", ["grp"], ["Text", "kind"])
    got = sorted((r["Text"] or "", r["Tag"], r["grp"]) for r in alike.collect())
    assert len(got) == 7 and got[4][1:] == got[5][1:] and got[4][0] == "GYM x"
    assert all(r[f"{c}"] == f"v{i}" for r in alike.collect() for i, c in enumerate(ODD))
    filled = profile.fill_columns(named, fill, ["grp"], "id")
    assert filled.columns == named.columns and filled.count() == 7


def test_one_join_for_all_kinds(spark):
    """Rows with other columns filled are of other kinds; all go through two joins, whatever their number."""
    from lexitag.operators import similar

    learn = rows(spark, [(i, f"t{i}", f"TEXT {i}{i}", f"grp{i}", f"loc{i % 3}") for i in range(9)])
    data = [(100 + i, "", f"TEXT {i % 9}{i % 9}", f"grp{i}" if i % 2 else "", f"loc{i}" if i % 3 else "x") for i in range(36)]
    calls, whole = [], similar._best_per_text

    def counted(*given):
        calls.append(1)
        return whole(*given)

    similar._best_per_text = counted
    try:
        got = legacy.tag_similar(rows(spark, data), learn, "id", [], ["Text", "grp", "loc"])
        got = {r["id"]: (r["Tag"], r["Quality"]) for r in got.collect()}
    finally:
        similar._best_per_text = whole
    plain = [dict(zip(("id", "Tag", "Text", "grp", "loc"), r)) for r in data]
    known = [r.asDict() for r in learn.collect()]
    assert got == {r["id"]: plain_similar(r, known, ["Text", "grp", "loc"]) for r in plain}
    assert len(calls) == 2


def test_profile_names(spark):
    df = rows(spark, [(i, f"t{i % 2}", "x", f"g{i}", "") for i in range(20)])
    assert profile.unique_and_other_columns(df, ["grp", "loc"]) == (["grp"], ["loc"])
    assert profile.variable_columns(df, ["grp", "loc", "Tag"]) == ["grp", "loc", "Tag"]
    assert profile.empty_columns(df, ["grp", "loc"]) == ["loc"]
    new = df.withColumns({})
    assert profile.compare_columns(new, df, ["Tag", "grp", "loc"]) == (["grp"], ["Tag", "loc"])


def test_cascade(spark, tmp_path):
    learn = rows(spark, [(i + 100, *r[1:]) for i, r in enumerate(LEARN)] + [(90 + i, "it", f"EXTRA{i} W", "g2", "B") for i in range(3)])
    new = new_rows(spark, "laptop  fee", "GYM zz", "BLUE zz", "BOKS DELL SHEETZ", "")
    vocab = flows.learn_cascade(learn, new, "id")
    flows.save_cascade(vocab, str(tmp_path))
    loaded = flows.load_cascade(spark, str(tmp_path))
    assert loaded.fill_cols == sorted(vocab.fill_cols)
    assert loaded.tags.count() == vocab.tags.count()
    assert (loaded.columns is None) == (vocab.columns is None)
    old, tagged, conflicts = flows.run_cascade(learn, new, vocab, "id", by_column=True)
    assert [(r["id"], r["Tag"], r["Edit"]) for r in old.collect()] == [(0, "it", "OLD")]
    got = {r["id"]: r for r in tagged.collect()}
    assert sorted(got) == [1, 2, 3, 4]
    assert (got[1]["Tag"], got[1]["Quality"]) == ("y", 1.0)
    assert (got[2]["Tag"], got[2]["Quality"]) == ("paper", 1.0)
    assert got[3]["Tag"] == "paper" and 0.25 <= got[3]["Quality"] < 1
    assert (got[4]["Tag"], got[4]["Quality"]) == ("", 0.0)
    assert conflicts.count() == 0


def test_null_tag_is_no_tag(spark):
    from lexitag.operators import legacy

    rows = spark.createDataFrame([(1, "a"), (2, ""), (3, None)], "id long, Tag string")
    tagged, left = legacy.split_tagged(rows)
    assert [r["id"] for r in tagged.collect()] == [1]
    assert sorted(r["id"] for r in left.collect()) == [2, 3]


def test_known_rows_need_no_stage(spark, sf, monkeypatch):
    learn, new = inputs.legacy_suppliers(spark, sf), inputs.legacy_customers(spark, sf)
    wanted = flows.run_cascade(learn, new, flows.learn_cascade(learn, new, "id"), "id")[0]
    for name in ("tag_relevance", "tag_by_ngram", "tag_similar"):
        monkeypatch.setattr(legacy, name, None)
    monkeypatch.setattr(ngrams, "tag_ngrams", None)
    got = tagging.cascade_old(spark, sf)
    assert got.columns == wanted.columns and got.count() > 0
    assert sorted(got.collect()) == sorted(wanted.collect())
