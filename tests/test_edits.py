import random

from lexitag.operators import edits


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(token, words, count, least):
    found = []
    for w in words:
        n, longest = distance(token, w), max(len(token), len(w))
        if n * 100 <= (100 - least) * longest:
            found.append((round(1.0 - n / longest, 12), w))
    return sorted(found, reverse=True)[:count]


def test_edits_equal_brute_force(spark):
    rng = random.Random(11)
    make = lambda letters, n: "".join(rng.choices(letters, k=n))
    words = {make(letters, rng.randrange(1, 16)) for letters in ("ab", "abcde", "aü東b") for _ in range(130)}
    words |= {"a" * n for n in range(1, 14)} | {"ab" * n for n in range(3, 7)} | {make("abcdef", 300)}

    def typo(w):
        i = rng.randrange(len(w))
        return rng.choice([w[:i] + w[i + 1 :], w[:i] + "c" + w[i:], w[:i] + "c" + w[i + 1 :], w])

    tokens = {typo(typo(w)) if len(w) > 1 else w for w in sorted(words)} - {""}
    asked = spark.createDataFrame([*((t,) for t in sorted(tokens)), (None,), ("",), ("aaaaaa",), ("aaaaaa",)], "token string")
    offered = spark.createDataFrame([*((w,) for w in sorted(words)), (None,), ("",)], "word string")
    tokens.add("aaaaaa")
    for least in (75, 80, 90):
        got = {}
        for r in edits.words_within_edits(asked, offered, 3, least).collect():
            got.setdefault(r["token"], []).append((round(r["similarity"], 12), r["word"]))
        got = {t: sorted(v, reverse=True) for t, v in got.items()}
        long = [w for w in words if len(w) >= 5]
        want = {t: brute(t, long, 3, least) for t in tokens if len(t) >= 5}
        assert got == {t: v for t, v in want.items() if v}


def test_no_words_no_matches(spark):
    none = spark.createDataFrame([], "word string")
    assert edits.words_within_edits(none.withColumnRenamed("word", "token"), none, 2).count() == 0
