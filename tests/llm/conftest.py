import json
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

SCHEMAS = {
    "documents": [("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())],
    "labels": [("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())],
    "pages": [("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())],
    "embeddings": [("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32())],
}
#: Names that the operators compute under; here they are columns of the input, with other content.
CLASHES = ["id", "key", "size", "source_size", "kept", "fp", "flags", "d_id", "n_words", "pieces", "bundle", "shard", "copies", "row"]


def _store(folder, tables):
    for name, rows in tables.items():
        fields = SCHEMAS[name] + [(c, pa.string()) for c in CLASHES if c not in dict(SCHEMAS[name])]
        width = len(SCHEMAS[name])
        columns = list(zip(*[(*r, *["other"] * (len(fields) - width)) for r in rows])) or [[]] * len(fields)
        table = pa.table({n: pa.array(list(c), t) for (n, t), c in zip(fields, columns)})
        pq.write_table(table, folder / f"{name}.parquet", row_group_size=50)
    return str(folder)


def messy_documents():
    rng = random.Random(3)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    text = lambda n: " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))
    rows = [(i, f"Shared LINE\t\n{text(30)}\n  shared line \n{text(12)}", "en", f"s{i % 3}", 1) for i in range(12)]
    base = text(120)
    rows += [(100 + i, base, "de", "hot", 1) for i in range(30)]
    rows += [(200 + i, f"{base} {text(1)}", "de", "hot", 1) for i in range(20)]
    rows += [(300, None, None, None, None), (301, "", "en", "s1", 0), (302, " \n\t\n", None, "s1", 0), (303, "one", "fr", None, 3)]
    rows += [(304, text(12) + "\n\x0b\f\r", "en", "", 0), (None, text(40), "en", "s2", 0), (None, None, None, None, None)]
    rows += [(305, text(40), "es", "s2", 0)] * 3 + [(306, "a" * 20_000, "en", "s2", 0), (307, text(9000), "en", "s2", 0)]
    rows += [(308, "x y z w v " * 30, "en", "s2", 0), (309, "#### $$$ |||| &&& " * 20, "en", "s2", 0)]
    rows += [(310, "Größe naïve façade 東京 123 —    x's I'll !!!\n\n\n  end  ", "xx", "é", 0)]
    rows += [(311, "\n".join(f"line {i} {text(3)}" for i in range(400)), "en", "s0", 0)]
    return rows


@pytest.fixture(scope="session")
def messy(tmp_path_factory):
    """Nulls, empty and long texts, ties, repeated rows, and columns with clashing names."""
    rng = random.Random(5)
    vector = lambda: [rng.uniform(-1, 1) for _ in range(6)]
    vectors = [(i, vector(), 0) for i in range(150)] + [(i, [0.5] * 6, 0) for i in range(150, 230)]
    vectors += [(300, None, 0), (301, [None] + [0.1] * 5, 0), (302, [float("nan")] * 6, 0), (303, [float("inf")] * 6, 0)]
    vectors += [(None, vector(), 0), (304, [], 0), (350, [1.0, 2.0], 0), (351, [2.0, 1.0], 0)] + [(352, vector(), 0)] * 2
    page = "<html>" + "abc " * 60 + "</html>"
    pages = [(i, f"http://x/{i}", page) for i in range(40, 0, -1)] + [(50, None, None), (51, "u\r\nWARC-Type: x", "short"), (52, "u", "short")]
    pages += [(60, "u", "y" * 100), (60, "u", "y" * 100), (61, "u", "y" * 99), (62, "u", "y" * 99), (None, "u", "z" * 500), (None, "u", "z" * 500)]
    pages += [(70, "http://long", "ü\r\n\r\n" * 100_000), (71, "u", ""), (None, None, page)]
    documents = messy_documents()
    labels = [(d[0], 1, 1 if d[0] and d[0] % 7 == 0 else 0) for d in documents] + [(None, None, None), (5, 1, None), (999, 1, 1)]
    tables = {"documents": documents, "labels": labels, "pages": pages, "embeddings": vectors}
    return _store(tmp_path_factory.mktemp("messy"), tables)


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    return _store(tmp_path_factory.mktemp("empty"), {name: [] for name in SCHEMAS})


@pytest.fixture(scope="session")
def rows():
    """Reads columns of a stored table as tuples."""

    def read(folder, table, *columns):
        got = pq.read_table(f"{folder}/{table}.parquet", columns=list(columns))
        return list(zip(*(got[c].to_pylist() for c in columns)))

    return read


@pytest.fixture(scope="session")
def same():
    """Do a DataFrame's columns hold exactly these rows, in any order?"""

    def check(df, columns, wanted, digits=9):
        plain = lambda v: float(f"{v:.{digits}g}") if isinstance(v, float) else v
        plain = lambda v, f=plain: int(v) if isinstance(v, float) and v == int(v) else f(v)
        key = lambda r: json.dumps([plain(v) for v in r], default=str)
        got = sorted(key(r) for r in df.select(*columns).collect())
        assert got == sorted(map(key, wanted))

    return check
