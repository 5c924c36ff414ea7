"""Every query against a plain version, on the given tables, on messy ones and on empty ones."""

import duckdb
import numpy as np
import pytest

from lexitag.llm import kdtree, linededup, mixing, ordering, quality, simhash, subwords, toxicity, warc
from lexitag.llm.queries import ORACLES, QUERIES
from tests.llm import brute

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(params=["small", "messy", "empty"])
def folder(request, messy, empty):
    return {"small": SMALL, "messy": messy, "empty": empty}[request.param]


def _sql(folder, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    result = con.execute(ORACLES[name])
    return [d[0] for d in result.description], result.fetchall()


def test_op1_training_order(spark, folder, rows, same):
    coder = brute.encoding()
    parts = []
    for doc_id, text in rows(folder, "documents", "doc_id", "text"):
        ids = [*coder.encode_ordinary(text or ""), 50256]
        parts += [(doc_id, i // 512, ids[i : i + 512]) for i in range(0, len(ids), 512)]
    wanted = []
    for number, (doc_id, part, ids) in enumerate(parts):
        slot = brute.slot(number, len(parts), ordering.KEY)
        digest = brute.sha(np.array(ids, "<u2").tobytes())
        wanted.append((slot, slot // ordering.SHARD_ROWS, slot % ordering.SHARD_ROWS * 1024, doc_id, part, len(ids), digest))
    assert sorted(w[0] for w in wanted) == list(range(len(parts)))
    columns = ["slot", "shard", "offset", "doc_id", "part", "n_tokens", "ids_sha256"]
    same(QUERIES["op1_training_order"](spark, folder), columns, wanted)


def test_ids_take_the_end_mark_for_text():
    import public_tokenizers as tokenizers

    from lexitag.llm.bpe import read_ranks

    coder = ordering._Tokens.of(read_ranks(tokenizers.path("byte_bpe_50k.tiktoken")), tokenizers.PATTERN)
    for text in ("", "a<|end|>b <|end|>", "<|e<|end|>", "\u00e9<|endoftext|>\u00fc", "x" * 100_000):
        assert ordering._ids(text, coder).tolist() == brute.encoding().encode_ordinary(text)
        cut = ordering._cut(text, coder, 64, 50256)
        assert cut.shape[1] == 64 and cut[cut != ordering.FILL].tolist() == [*brute.encoding().encode_ordinary(text), 50256]


def test_shards_are_read_on_from_any_slot(spark, tmp_path):
    import public_tokenizers as tokenizers

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    target = str(tmp_path / "shards")
    vocabulary = tokenizers.path("byte_bpe_50k.tiktoken")
    settings = dict(length=64, shard_rows=100, key=9)
    order, index = ordering.write(docs, "doc_id", "text", target, vocabulary, tokenizers.PATTERN, **settings)
    every = list(ordering.read_slots(target))
    assert len(every) == order.sequences == index.count() and ordering.read_order(target) == order
    later = list(ordering.read_slots(target, 250, 420))
    assert all((a == b).all() for a, b in zip(later, every[250:420])) and len(later) == 170
    texts = {r["slot"]: (r["id"], r["part"]) for r in index.collect()}
    first = {texts[s][0]: ids for s, ids in enumerate(every) if texts[s][1] == 0}
    coder = brute.encoding()
    for r in docs.collect():
        assert first[r["doc_id"]].tolist() == [*coder.encode_ordinary(r["text"]), 50256][:64]
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "shards").glob("shard-*")}
    ordering.write(docs, "doc_id", "text", target, vocabulary, tokenizers.PATTERN, resume=True, **settings)
    assert before == {p.name: p.stat().st_mtime_ns for p in (tmp_path / "shards").glob("shard-*")}


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation_is_a_bijection(n):
    assert sorted(ordering.permute(np.arange(n), n, 77).tolist()) == list(range(n))
    if n > 100:
        assert (ordering.permute(np.arange(n), n, 77) != ordering.permute(np.arange(n), n, 78)).any()


def test_op2_mixing(spark, folder, rows, same):
    df = QUERIES["op2_mixing"](spark, folder)
    data = rows(folder, "documents", "doc_id", "text", "source")
    wanted = brute.taken(data) if data else []
    same(df, ["doc_id", "size", "source_size", "target", "taken"], wanted)
    columns, found = _sql(folder, "op2_mixing")
    same(df, columns, found)


def test_mixed_documents(spark, messy, rows, same):
    docs = spark.read.parquet(f"{messy}/documents.parquet").filter("doc_id < 305 or doc_id > 305")
    plan = mixing.plan(docs, "doc_id", "text", "source")
    got = mixing.mixed_documents(docs, plan, "doc_id", "text", "source")
    assert got.columns == docs.columns
    data = [r for r in rows(messy, "documents", "doc_id", "text", "source") if r[0] is not None and r[0] != 305]
    same(got.filter("text rlike '[^\\\\x20\\\\x09-\\\\x0D]'"), ["doc_id", "text"], brute.mixed(data))


def test_prefix_sums_over_many_buckets(spark):
    data = spark.range(5000).selectExpr("'g' AS g", "conv(substring(md5(cast(id AS string)), 1, 15), 16, 10) + 0L AS k", "id % 7 AS v", "2000 AS b")
    got = mixing.prefix_sums(data.selectExpr("g", "cast(k AS long) AS k", "v", "b"), "g", "k", "v", "b").orderBy("k").collect()
    total = 0
    for r in got:
        assert r["before"] == total
        total += r["v"]


def test_op3_top_k(spark, folder, rows, same):
    vectors = []
    for i, v in rows(folder, "embeddings", "vec_id", "embedding"):
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            vectors.append((i, [int(np.floor(256 * float(x))) for x in v]))
    queries = [(i, v) for i, v in vectors if i % 50 == 0]
    same(QUERIES["op3_top_k"](spark, folder), ["query_id", "rank", "vec_id", "score"], brute.top_k(vectors, queries, 5))


def test_trees_over_many_shards(spark, monkeypatch, same):
    monkeypatch.setattr(kdtree, "SHARD_ROWS", 40)
    monkeypatch.setattr(kdtree, "BLOCK", 7)
    rng = np.random.default_rng(1)
    data = [(i, [float(x) for x in rng.integers(-3, 4, 5)]) for i in range(500)]
    df = spark.createDataFrame(data, "vec_id long, v array<double>")
    got = kdtree.top_k(df, df.filter("vec_id % 9 = 0"), "vec_id", "v", 4)
    whole = [(i, [int(x) for x in v]) for i, v in data]
    same(got, ["query_id", "rank", "vec_id", "score"], brute.top_k(whole, [r for r in whole if r[0] % 9 == 0], 4))


def test_tree_leaves_out_nodes():
    rng = np.random.default_rng(2)
    vectors = np.rint(rng.normal(0, 40, (2000, 2)))
    tree = kdtree.KDTree(np.arange(2000), vectors)
    counted = []
    real = tree.vectors

    class Counting(np.ndarray):
        def __getitem__(self, key):
            counted.append(key)
            return np.asarray(self).__getitem__(key)

    tree.vectors = real.view(Counting)
    tree.search(np.array([[100.0, 20.0]]), np.array([-1]), 3, np.array([-np.inf]))
    assert 0 < len(counted) < 8  # of 32 leaves


def test_large_components_stay_exact(spark, same):
    data = [(0, [2.0**40, 1.0]), (1, [2.0**40, 3.0]), (2, [2.0**40, 2.0]), (3, [1e30, 0.0])]
    df = spark.createDataFrame(data, "vec_id long, v array<double>")
    got = kdtree.top_k(df, df.filter("vec_id = 0"), "vec_id", "v", 3)
    wanted = [(0, n, n, 2**63 - 1) for n in (1, 2, 3)]
    same(got, ["query_id", "rank", "vec_id", "score"], wanted)


def test_op4_line_dedup(spark, folder, rows, same):
    wanted = [(*r[:3], brute.sha(r[3].encode())) for r in brute.line_dedup(rows(folder, "documents", "doc_id", "text"))]
    df = QUERIES["op4_line_dedup"](spark, folder)
    same(df, ["doc_id", "n_lines", "n_dropped", "kept_sha256"], wanted)
    columns, found = _sql(folder, "op4_line_dedup")
    same(df, columns, found)


def test_repeated_rows_are_documents_each(spark):
    rows = [(7, "same line\nother\nsame line")] * 12 + [(None, "rare")] * 9 + [(8, None)] * 11
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = linededup.report(df, "doc_id", "text").collect()
    wanted = brute.line_dedup(rows)
    key = lambda r: (r[0] is None, r[0] or 0)
    assert [tuple(r) for r in sorted(got, key=key)] == sorted(((d, n, k, t or None if d == 8 else t) for d, n, k, t in wanted), key=key)
    assert {(r["id"], r["n_dropped"]) for r in got} == {(7, 3), (None, 0), (8, 0)}


def test_drop_lines_hands_columns_on(spark, messy):
    docs = spark.read.parquet(f"{messy}/documents.parquet")
    got = linededup.drop_lines(docs, "doc_id", "text")
    assert got.schema == docs.schema and got.count() == docs.count()
    assert got.filter("text is null").count() == docs.filter("text is null").count()


def test_op5_simhash(spark, folder, rows, same):
    data = rows(folder, "documents", "doc_id", "text")
    prints = [brute.fingerprint(t, 3) for _, t in data]
    first = brute.components(prints)
    least = {}
    for (doc_id, _), c in zip(data, first):
        if doc_id is not None:
            least[c] = min(least.get(c, doc_id), doc_id)
    wanted = [(d, f"{p:016x}", least.get(c)) for (d, _), p, c in zip(data, prints, first)]
    same(QUERIES["op5_simhash"](spark, folder), ["doc_id", "fingerprint", "component_id"], wanted)


def test_one_document_of_each_group_stays(spark, messy, rows):
    data = rows(messy, "documents", "doc_id", "text")
    docs = spark.read.parquet(f"{messy}/documents.parquet")
    got = simhash.keep_first(docs, "doc_id", "text")
    groups = brute.components([brute.fingerprint(t, 3) for _, t in data])
    least = {}
    for (doc_id, _), c in zip(data, groups):
        least[c] = min(least.get(c, (True, 0)), (doc_id is None, doc_id or 0))
    assert got.schema == docs.schema
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got.collect())
    assert ids == sorted(least.values())


def test_links_of_a_large_shard(spark, monkeypatch):
    """Many fingerprints in one shard: it is cut into pieces, and no link is lost."""
    monkeypatch.setattr(simhash, "PIECE", 16)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 6)
    prints = {int(b) for b in base}
    for b in base:
        for _ in range(60):
            prints.add(int(b) ^ sum(1 << int(x) for x in rng.choice(62, rng.integers(1, 5), replace=False)))
    prints = sorted(prints)
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    got = {r["fp"]: r["root"] for r in simhash.components(simhash.edges(df)).collect()}
    wanted = brute.components(prints)
    same_group = {}
    for p, c in zip(prints, wanted):
        assert same_group.setdefault(got.get(p, p), c) == c
    assert len(same_group) == len(set(wanted))


def test_bk_tree_finds_all():
    rng = np.random.default_rng(6)
    values = np.unique(rng.integers(0, 2**12, 300))
    q, at = simhash.BKTree(values).search(values, 2)
    found = set(zip(q.tolist(), at.tolist()))
    assert found == {(i, j) for i in range(len(values)) for j in range(len(values)) if int(values[i] ^ values[j]).bit_count() <= 2}


def test_op6_toxicity(spark):
    import zlib

    folder = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in QUERIES["op6_toxicity"](spark, folder).collect()}
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
    scored = []
    for r in spark.read.parquet(f"{folder}/labels.parquet").collect():
        row = got[r["doc_id"]]
        assert row["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= row["score"] <= 1 and row["predicted"] == (row["score"] >= 0.5)
        if row["held_out"]:
            scored.append((row["score"], r["toxic"]))
    toxic, clean = ([s for s, t in scored if t == v] for v in (1, 0))
    order = sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) / (len(toxic) * len(clean))
    assert order > 0.9  # the table has some 350 toxic texts to learn from, in four languages
    assert sum(s >= 0.5 for s in toxic) > 0.8 * len(toxic)
    assert sum(s >= 0.5 for s in clean) < 0.15 * len(clean)  # 0.05 is still to be reached here (see README)


def _plain_windows(text):
    marks = "".join(map(chr, range(33, 48))) + ":;?@[]_{}|~"
    words = [w for w in (x.strip(marks) for x in (text or "").lower().split()) if w]
    return [words[i : i + 3] for i in range(0, len(words), 3)] or [[]]


def test_toxicity_scores_in_plain_python(rows):
    """Every score follows from the stored weights by plain averages, maximum and logistic function."""
    texts = [t for _, t in rows(SMALL, "documents", "doc_id", "text")][:60] + ["", None, "one", "two words", "a b c d"]
    rng = np.random.default_rng(1)
    model = toxicity.Model(rng.normal(0, 3, toxicity.BUCKETS).astype(np.float32), -0.4)

    def word(w):
        buckets, _ = subwords.grams([w], toxicity.SIZES, toxicity.BUCKETS)
        return sum(float(model.weights[b]) for b in buckets) / len(buckets)

    for text, got in zip(texts, model.score(texts)):
        best = max(sum(map(word, ws)) / max(1, len(ws)) for ws in _plain_windows(text))
        assert got == pytest.approx(1 / (1 + np.exp(-(best + model.bias))), abs=1e-6)


def test_ngrams_are_counted_by_text():
    words, texts = ["ab", "abc", "xy"], [["ab", "ab", "xy"], [], ["abc"], ["ab", "abc"]] * 70
    bucket, ends = subwords.grams(words, toxicity.SIZES, toxicity.BUCKETS)
    _, slot = np.unique(bucket, return_inverse=True)
    which = np.array([words.index(w) for t in texts for w in t])
    doc = np.array([i for i, t in enumerate(texts) for _ in t])
    of = [set(slot[a:b]) for a, b in zip([0, *ends[:-1]], ends)]
    wanted = [sum(any(s in of[words.index(w)] for w in t) for t in texts) for s in range(slot.max() + 1)]
    assert toxicity._texts_with(slot, ends, which, doc).tolist() == wanted


def test_unseen_misspellings_share_vectors():
    rng = np.random.default_rng(0)
    syllables = "ba ko ri te mu sol pan de vi lur".split()
    sentence = lambda: ["".join(rng.choice(syllables, 3)) for _ in range(12)]
    clean = [" ".join(sentence()) for _ in range(150)]
    toxic = [" ".join([*sentence()[:6], str(rng.choice(["grobling", "groblings"])), *sentence()[:5]]) for _ in range(150)]
    model = toxicity.fit(clean + toxic, [0] * 150 + [1] * 150)
    got = model.score([" ".join([*sentence(), "groblingg"]), " ".join(sentence()), "", None])
    assert got[0] > 0.5 > got[1] and got[2] == got[3]


@pytest.mark.parametrize("name", ["op6_toxicity", "op10_language_id"])
def test_classifiers_on_messy_and_empty_tables(spark, messy, empty, name):
    got = QUERIES[name](spark, messy)
    assert got.count() == spark.read.parquet(f"{messy}/documents.parquet").count()
    assert got.filter("score is null or score < 0 or score > 1").isEmpty()
    assert QUERIES[name](spark, empty).isEmpty()
    if name == "op10_language_id":
        und = {r["doc_id"] for r in got.filter("lang_pred = 'und'").collect()}
        assert und >= {300, 301, 302, 309} and 303 not in und


def test_op7_warc(spark, folder, rows, same):
    wanted = brute.revisits(rows(folder, "pages", "page_id", "html"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    same(QUERIES["op7_warc"](spark, folder), columns, wanted)


def test_bundles_are_zstandard_and_seekable(spark, tmp_path):
    import zstandard

    target = str(tmp_path / "bundles")
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    index = warc.write(pages, "page_id", "url", "html", target, frame_bytes=20_000)
    back = {r["id"]: r["payload"].decode() for r in warc.read(index, target).collect()}
    assert back == {r["page_id"]: r["html"] for r in pages.collect()}
    (bundle,) = (tmp_path / "bundles").glob("bundle-*")
    whole = zstandard.ZstdDecompressor().stream_reader(bundle.read_bytes(), read_across_frames=True).read()
    assert whole.count(b"WARC/1.1\r\n") == 50 and index.select("frame").distinct().count() > 3
    reader = warc.BundleReader(target, 0)
    one = index.orderBy("frame").tail(1)[0]
    headers, payload = warc.parse(reader.frame(one["frame"]), one["offset"])
    assert payload.decode() == back[one["id"]] and headers["warc-type"] == "response"


def test_op8_byte_bpe(spark, folder, rows, same):
    coder = brute.encoding()
    wanted = []
    for doc_id, text in rows(folder, "documents", "doc_id", "text"):
        ids = coder.encode_ordinary(text or "")
        wanted.append((doc_id, len(ids), brute.sha(np.array(ids, "<u4").tobytes()), brute.sha((text or "").encode())))
    same(QUERIES["op8_byte_bpe"](spark, folder), ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], wanted)


def test_encode_and_decode_as_tables(spark, messy, rows):
    import public_tokenizers as tokenizers

    from lexitag.llm import bpe

    vocabulary = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = spark.read.parquet(f"{messy}/documents.parquet").filter("doc_id >= 300")
    ids = bpe.encode(docs, "doc_id", "text", vocabulary, tokenizers.PATTERN)
    coder = brute.encoding("byte_bpe_multi_50k.tiktoken")
    texts = {d: t or "" for d, t in rows(messy, "documents", "doc_id", "text") if d is not None and d >= 300}
    assert {r["id"]: r["ids"] for r in ids.collect()} == {d: coder.encode_ordinary(t) for d, t in texts.items()}
    assert {r["id"]: bytes(r["bytes"]).decode() for r in bpe.decode(ids, vocabulary).collect()} == texts


def test_op9_quality(spark, folder, rows, same):
    df = QUERIES["op9_quality"](spark, folder)
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    same(df, base, brute.quality(rows(folder, "documents", "doc_id", "text")))
    columns, found = _sql(folder, "op9_quality")
    same(df, columns, found)


def test_keep_documents_hands_columns_on(spark, messy):
    docs = spark.read.parquet(f"{messy}/documents.parquet")
    got = quality.keep_documents(docs, "text", "lang", "source")
    kept = quality.decide(docs, "doc_id", "text", "lang", "source").filter("kept")
    assert got.schema == docs.schema and got.count() == kept.count()
    assert {300, 301, 303, 308}.isdisjoint(r["doc_id"] for r in got.collect())


def _merged_quartiles(rows):
    """Plain thresholds: rows of (lang, source, ratio, bucket, count)."""
    prior, found = quality.PRIOR, {}
    for lang, source, ratio in {r[:3] for r in rows}:
        every = [r for r in rows if r[2] == ratio]
        tongue = [r for r in every if r[0] == lang]
        own = [r for r in tongue if r[1] == source]
        n_all, n_lang, n = (sum(r[4] for r in part) for part in (every, tongue, own))
        at = {}
        for part, weight in ((own, n_all * (n_lang + prior)), (tongue, prior * n_all), (every, prior * prior)):
            for r in part:
                at[r[3]] = at.get(r[3], 0) + weight * r[4]
        assert sum(at.values()) == (n + prior) * n_all * (n_lang + prior)
        for q, name in ((1, "low"), (3, "high")):
            upto = 0
            for bucket in sorted(at):
                upto += at[bucket]
                if upto * 4 >= sum(at.values()) * q:
                    found[lang, source, f"{ratio}_{name}"] = bucket
                    break
    return found


def test_every_group_has_thresholds_of_its_own(spark):
    import random

    rng, rows = random.Random(4), []
    for k, lang in enumerate(("=en", "=de", "")):
        for i in range(5):
            for ratio in quality.RATIOS:
                for b in rng.sample(range(200), 30):
                    rows.append((lang, f"=s{i}", ratio, 4_000 + 300 * i + 2 * b, rng.randrange(1, 2 + 10 ** (k + 1))))
    rows += [("=xx", "=one", r, 3 * 10**12, 1) for r in quality.RATIOS]  # a lone document leans on the others
    rows += [("=big", "=all", r, 5_000 + b, 3 * 10**9) for r in quality.RATIOS for b in (0, 16, 32, 48)]
    sketch = spark.createDataFrame(rows, "lang string, source string, ratio string, bucket long, count long")
    got = {
        (r["lang"], r["source"], name): r[name]
        for r in quality.thresholds(sketch).collect()
        for name in r.asDict()
        if name not in ("lang", "source")
    }
    assert got == _merged_quartiles(rows)
    highs = [got["=en", f"=s{i}", "word_length_high"] for i in range(5)]
    assert len(set(highs)) > 1 and got["=xx", "=one", "word_length_high"] < 10_000


def test_small_groups_have_thresholds_of_their_own(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    sketch = quality.sketches(quality._ratios(docs, "text", "lang", "source")).cache()
    found = quality.thresholds(sketch).collect()
    assert len(found) == sketch.select("lang", "source").distinct().count() > 10
    assert len({tuple(r)[2:] for r in found}) > len({r["lang"] for r in found})


def test_quality_labels_agree(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = QUERIES["op9_quality"](spark, folder).join(labels, "doc_id").select("quality", "kept", "base_failed").collect()
    good = [r for r in got if r["quality"] == 1 and not r["base_failed"]]
    assert np.mean([r["kept"] for r in good]) > 0.98


def test_op10_language_id(spark):
    import zlib

    folder = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in QUERIES["op10_language_id"](spark, folder).collect()}
    hits = []
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        row = got[r["doc_id"]]
        assert row["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        if row["held_out"]:
            hits.append(row["lang_pred"] == r["lang"])
    assert len(got) == 1000 and np.mean(hits) > 0.97


def test_grams_are_those_of_the_word():
    bucket, ends = subwords.grams(["ab", "xaby", "ab"], (3,), 1 << 20)
    first, second, third = np.split(bucket, ends[:-1])
    assert first.tolist() == third.tolist() and len(first) == 3 and len(second) == 5
