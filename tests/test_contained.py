from lexitag.operators import lookup, ngrams


def test_words_that_begin_alike_do_not_meet(spark, monkeypatch):
    """A token meets the words it contains, not all that share four or eight first characters with a part of it."""
    met, join = [], ngrams.lookup_join

    def counted(left, right, keys, *rest, **more):
        made = join(left, right, keys, *rest, **more)
        if list(keys) == ["seed"]:
            met.append(made.count())
        return made

    monkeypatch.setattr(ngrams, "lookup_join", counted)
    long = "station" * 3
    words = [f"tion{i}" for i in range(10, 90)] + ["tio", long, long + "x"]
    texts = [f"xxtionyy{i}" for i in range(40)] + ["atio", "tion42tion7", f"a{long}b", "x" * 300 + "tion88"]
    tokens = spark.createDataFrame([(t,) for t in texts], "token string").coalesce(1)
    vocabulary = spark.createDataFrame([(w, "t") for w in words], "Ngram string, ngramTag string").coalesce(1)
    got = sorted((r["token"], r["Ngram"]) for r in ngrams._containing(tokens, vocabulary).collect())
    want = sorted((t, w) for t in texts for w in words if w in t)
    assert got == want
    assert met[0] < 2 * len(want) + 10


def test_many_seeds_are_sifted_before_a_shuffle(spark, monkeypatch):
    """With too many words to broadcast, places where none begins are left out before the join."""
    dealt, join = [], lookup.salted_join

    def counted(left, right, keys, *rest, **more):
        if list(keys) == ["seed"]:
            dealt.append(left.count())
        return join(left, right, keys, *rest, **more)

    for module in (ngrams, lookup):
        monkeypatch.setattr(module, "fits_broadcast", lambda df: False)
    monkeypatch.setattr(lookup, "salted_join", counted)
    texts = [f"{a}{b}station{b}{a}" for a in "acfhk" for b in "mpqrz"] + [None]
    words = [("station", "t"), ("mstation", "u"), ("nowhere", "t"), ("amstation", "t"), ("apstation", "t"), ("aqstation", "t"), ("ppstation", "t")]
    rows = [(i, tag, f"{t} other" if t else t) for i, t in enumerate(texts) for tag in ("t", "tu", None)[: 1 + i % 3]]
    learn = spark.createDataFrame(rows, "id long, Tag string, Text string").coalesce(2)
    vocabulary = spark.createDataFrame(words, "Ngram string, ngramTag string").coalesce(1)
    got = sorted(tuple(r) for r in ngrams.verified_ngrams(vocabulary, learn, "id").collect())
    met = [(i, tag, w, t) for i, tag, text in rows if text for w, t in words if w in text]
    bad = {(w, t) for _, tag, w, t in met if tag is None or t not in tag}
    assert got == sorted({(i, w, t) for i, _, w, t in met if (w, t) not in bad}) and got
    assert dealt and dealt[0] < 2 * len(met)
