import random
import re

from lexitag.operators.clean import _alternations, exclude_patterns


def test_shared_starts_find_the_same(spark):
    rng = random.Random(3)
    make = lambda n: "".join(rng.choices("AB0 _", k=n))
    patterns = [make(rng.randrange(1, 7)) + rng.choice(["", "$"]) for _ in range(12)]
    patterns += ["ab$", "abb", "ABBA", "B.0", "^0A", "(A|B)_{2}", "_" * 40, "_" * 41 + "$"]
    for few in (patterns[:4], patterns[4:9], patterns[9:], patterns):
        cells = sorted({make(rng.randrange(0, 9)) for _ in range(300)} | {"_" * 39, "_" * 45, "0A", "AB\n"})
        rows = spark.createDataFrame([(c,) for c in cells], "c string").coalesce(1)
        got = sorted(r["c"] for r in exclude_patterns(rows, {"c": few}).collect())
        assert got == [c for c in cells if not any(re.search(p.upper(), c) for p in few)]


def test_long_lists_share_starts():
    """No place in a cell is compared with every pattern of a list."""
    (found,) = _alternations([f"{i:04d}$" for i in range(0, 10_000, 2)])
    assert found.startswith("(?:0(?:0(?:0(?:0$|2$") and len(found) < 5000 * 6
