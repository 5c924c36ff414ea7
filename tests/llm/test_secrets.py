"""The secret scan against plain Python's regular expressions, and its linking of weak parts."""

import random
import re

import pytest

from lexitag.llm import secrets
from lexitag.llm.queries import QUERIES
from tests.llm import brute
from tests.llm.test_operators import SMALL, _sql

RESULT = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def _base(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16])


def _all(text):
    breaks = [m.start() for m in re.finditer(secrets.BREAK, text)]
    parts = []
    for kind, (_, search, least, most, secret, weak) in enumerate(secrets.KINDS):
        pattern, group = secrets.SEARCHES[search]
        for m in re.finditer(pattern, text):
            if least <= len(m[group]) <= (most or 10**9):
                parts.append((m.start(), kind, m.end(), sum(b <= m.start() for b in breaks), secret, weak))
    near = lambda p, o: o[3] == p[3] and o[4] != p[4] and abs(o[0] - p[0]) <= secrets.REACH
    return sorted(p[:3] for p in parts if not p[5] or any(near(p, o) for o in parts))


def _text(found):
    return ",".join(f"{secrets.KINDS[k][0]}:{a}:{b}" for a, k, b in found)


def _wanted(rows):
    out = []
    for doc_id, text in rows:
        base = _base(text or "")
        counts = [sum(k == n for _, k, _ in base) for n in range(3)]
        out.append((doc_id, *counts, brute.sha(_text(base).encode()), _text(_all(text or ""))))
    return out


def _planted():
    rng = random.Random(12)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    value = lambda n: "".join(rng.choice("abcXYZ019+/_.=-") for _ in range(n))
    pieces = [
        lambda: f'{rng.choice(["password", "PassWd", "SECRET", "token", "api_key", "ApiKey"])}{rng.choice([" = ", ":", "=\"", "\" : \""])}{value(rng.randrange(1, 25))}',
        lambda: f"AKIA{''.join(rng.choice('ABCXYZ0129') for _ in range(rng.randrange(0, 20)))}",
        lambda: hexes(rng.randrange(10, 40)),
        lambda: f"{rng.choice(['user', 'Login', 'client_id', 'account'])}={value(rng.randrange(1, 9))}",
        lambda: f"{rng.choice(['pwd', 'auth', 'PRIVATE_KEY'])}: {value(rng.randrange(3, 12))}",
        lambda: rng.choice(["https://x.example.com/a?b=c", "host: db7.example.com:5432", "Bucket='data-1'"]),
        lambda: rng.choice(["\n\n", "\n \t\n\n", "\n", " ", "é" * 150, "wörd 東京 "]),
        lambda: " ".join("lorem" for _ in range(rng.randrange(60))),
    ]
    texts = ["".join(rng.choice(["", " ", "\n"]) + rng.choice(pieces)() for _ in range(rng.randrange(30))) for _ in range(250)]
    texts += ["token=token=abcdefghijkl password : abcdefghijklm", "token=password : abcdefghijklmnop", "K" * 3 + "paſsword=abcdefghijklmnop"]
    texts += [None, "", "user=abc\n" * 4000 + "\n" + "pwd=abcdef " * 4000, "host=a" + " " * 5000 + "pwd=abcdefgh"]
    rows = list(enumerate(texts))
    return rows + rows[5:8] + [(None, texts[9])]


@pytest.mark.parametrize("which", ["small", "messy", "empty"])
def test_op12_secrets(spark, which, messy, empty, rows, same):
    folder = {"small": SMALL, "messy": messy, "empty": empty}[which]
    df = QUERIES["op12_secrets"](spark, folder)
    same(df, RESULT, _wanted(rows(folder, "documents", "doc_id", "text")))
    columns, found = _sql(folder, "op12_secrets")
    same(df, columns, found)


def test_planted_parts(spark, same, tmp_path):
    data = _planted()
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    docs.selectExpr("*", "'x' AS row", "'y' AS spans", "'z' AS found").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    df = secrets.report(spark.read.parquet(f"{tmp_path}/documents.parquet"), "doc_id", "text").withColumnRenamed("id", "doc_id")
    wanted = _wanted(data)
    for name, *_ in secrets.KINDS:  # every kind is reported somewhere, and weak ones not everywhere
        assert any(name in w[5] for w in wanted)
    same(df, RESULT, wanted)


def test_weak_parts_alone_are_not_reported(spark):
    far = "lorem " * 60
    texts = ["pwd=abcdefg", "user=bob host=db1", f"user=bob {far} pwd=abcdefg", "user=bob\n\npwd=abcdefg", "user=bob\npwd=abcdefg"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r["id"]: r["spans"] for r in secrets.report(df, "id", "text").collect()}
    assert [got[i] for i in range(4)] == [""] * 4 and got[4] == "login:0:8,pass:9:20"


def test_no_python_and_no_pairs(spark):
    df = spark.createDataFrame([(1, "user=abc " * 300 + "pwd=abcdef " * 300)], "id long, text string")
    plan = secrets.report(df, "id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
