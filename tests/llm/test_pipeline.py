"""The pipeline against plain versions of its stages, each on what the stage before it kept."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from lexitag.llm.queries import ORACLES
from tests.llm import brute


def _first_of_groups(rows):
    """Of (doc_id, text, source): the smallest identifier of each group, null last."""
    stays = brute.near_duplicates([r[:2] for r in rows])
    out = []
    for row in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if (row[0] is None, row[0] or 0) in stays:
            stays.remove((row[0] is None, row[0] or 0))
            out.append(row)
    return out


def _wanted(folder):
    con = duckdb.connect()
    stored = f"(SELECT *, row_number() OVER () AS r FROM '{folder}/documents.parquet')"
    con.execute(f"CREATE VIEW documents AS SELECT r AS doc_id, text, lang, source, n_chars FROM {stored}")
    kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({ORACLES['op9_quality']}) WHERE kept").fetchall()}
    rows = [r[1:] for r in con.execute(f"SELECT r, doc_id, text, source FROM {stored}").fetchall() if r[0] in kept]
    lines = brute.line_dedup([r[:2] for r in rows])
    rows = _first_of_groups([(r[0], line[3], r[2]) for r, line in zip(rows, lines)])
    coder = brute.encoding()
    out = []
    for doc_id, text in brute.mixed(rows):
        ids = coder.encode_ordinary(text)
        out.append((doc_id, len(ids), brute.sha(np.array(ids, "<u4").tobytes()), brute.sha(text.encode())))
    return out


@pytest.fixture(scope="module")
def given(tmp_path_factory):
    """The smallest given table with repeated rows, and some documents without an identifier."""
    table = pq.read_table("/root/testdata/sf0.001/documents.parquet")
    copies = table.slice(3, 4)
    nameless = table.slice(140, 12).set_column(0, "doc_id", pa.nulls(12, pa.int64()))
    texts = [" ".join(reversed(t.split())) for t in nameless["text"].to_pylist()]
    nameless = nameless.set_column(1, "text", pa.array(texts, pa.string()))
    folder = tmp_path_factory.mktemp("given")
    pq.write_table(pa.concat_tables([table, copies, copies, nameless]), folder / "documents.parquet")
    return str(folder)


def test_pipeline(spark, same, given):
    got = corpus_pipeline.run(spark, given)
    wanted = _wanted(given)
    assert any(w[0] is None for w in wanted)
    same(got.filter("n_tokens > 0"), ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], wanted)


@pytest.mark.parametrize("which", ["messy", "empty"])
def test_stages_keep_columns(spark, which, request, tmp_path):
    folder = request.getfixturevalue(which)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    schema = docs.schema
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, folder)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert made.schema == schema
        made.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.isEmpty() == (which == "empty")
