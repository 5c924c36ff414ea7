"""Byte-level BPE: DuckDB contracts token-position rows per partition, ordered aggregation decodes.

Spark splits the texts into pieces (one pass in the JVM) and spreads the work; inside a task the
distinct pieces of a few batches become rows (piece, position, token) of a DuckDB table. A recursive
query joins neighbouring rows with the merge table and contracts, in every piece at once, the
leftmost pair of least rank, until no piece has a pair left. Decoding joins token ids with the
vocabulary and concatenates the bytes of each text in order of position.

Defined cases: a null text is an empty one; an empty text has no ids and decodes to no bytes; a
piece that is itself a token is that token; repeated rows are encoded each; other columns of the
input, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitag.llm.common import quoted, text_batches

#: Unicode white space, as the public pattern's \s means it (fixed value).
_SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Pieces of at most so many bytes are contracted by the recursive query, whose work grows with the
#: square of a piece's length; longer ones by a heap, with the same result.
QUERY_BYTES = 200
#: Pieces gathered before the distinct ones among them are encoded; distinct pieces remembered
#: per generation of a worker's memory (two are held); rows that decoding holds at once; rows that one
#: run of the recursive query makes at most, a row per token and step (a longer piece alone).
GATHER = 400_000
CONTRACT_ROWS = 300_000
REMEMBER = 250_000
DECODE_ROWS = 400_000
RUNS_PER_GROUP = 4096

#: The state is one row per token, keyed by piece and position in it (k = piece * 256 + position).
STEP = """
WITH RECURSIVE t(k, tok, step) AS (
    SELECT (piece::BIGINT << 8) | pos, tok, 0 FROM start
  UNION ALL (
    WITH least_pairs AS (
      SELECT a.k >> 8 AS piece, min((m.merged::BIGINT << 8) | (a.k & 255)) AS best
      FROM t a JOIN t b ON b.k = a.k + 1
      JOIN merges m ON m.pair = (a.tok::BIGINT << 32) | b.tok
      GROUP BY 1)
    SELECT CASE WHEN (t.k & 255) > (best & 255) THEN t.k - 1 ELSE t.k END,
           CASE WHEN (t.k & 255) = (best & 255) THEN (best >> 8)::INTEGER ELSE t.tok END,
           t.step + 1
    FROM t JOIN least_pairs p ON p.piece = t.k >> 8
    WHERE (t.k & 255) <> (best & 255) + 1))
SELECT (t.k >> 8)::INTEGER AS piece, tok
FROM t JOIN (SELECT k >> 8 AS piece, max(step) AS step FROM t GROUP BY 1) last
  ON last.piece = t.k >> 8 AND last.step = t.step
ORDER BY t.k
"""
DECODE = """
SELECT part, string_agg(s, '' ORDER BY pos) AS s FROM ids JOIN vocabulary USING (id) GROUP BY part
"""


def java_pattern(pattern: str) -> str:
    """The public split pattern for Java: \\s stands for Unicode white space."""
    return (
        pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]")
    )


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by id from a rank file (base64 token, id), read where it is given."""
    with open(path, "rb") as lines:
        found = {int(i): base64.b64decode(t) for t, i in map(bytes.split, lines)}
    if sorted(found) != list(range(len(found))):
        raise ValueError(f"{path}: ids are not 0, 1, 2 ...")
    return [found[i] for i in range(len(found))]


class _Coder:
    """One worker's tables: vocabulary, merges, and the pieces encoded so far."""

    def __init__(self, tokens: Sequence[bytes]):
        import duckdb

        self.tokens = tokens
        self.ids = {t: i for i, t in enumerate(tokens)}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        left, right, merged = [], [], []
        for t, i in self.ids.items():
            for k in range(1, len(t)):
                a, b = self.ids.get(t[:k]), self.ids.get(t[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(i)
        pair = (np.array(left, np.int64) << 32) | np.array(right, np.int64)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        self.db.register("m", pa.table({"pair": pair, "merged": np.array(merged, np.int32)}))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM m")
        texts = pa.array([t.decode("latin-1") for t in tokens])
        self.db.register("v", pa.table({"id": np.arange(len(tokens), dtype=np.int32), "s": texts}))
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM v")
        self.sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.blank_first = np.array([t[:1] == b" " for t in tokens])
        self.byte_ids = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)

    def _contract(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (little-endian 32 bits each) of pieces that are no tokens."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        starts = np.cumsum(lengths) - lengths
        piece = np.repeat(np.arange(len(pieces), dtype=np.int32), lengths)
        pos = (np.arange(len(piece)) - starts[piece]).astype(np.int32)
        tok = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        self.db.register("start", pa.table({"piece": piece, "pos": pos, "tok": tok}))
        done = self.db.execute(STEP).fetchnumpy()
        self.db.unregister("start")
        raw = done["tok"].astype("<u4").tobytes()
        ends = np.cumsum(np.bincount(done["piece"], minlength=len(pieces))) * 4
        return [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def _contract_long(self, piece: bytes) -> bytes:
        """The same contraction by a heap of (rank, position) and a chain of positions."""
        tok = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(tok)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        end = list(range(1, n + 1))
        rank = lambda i: self.ids.get(piece[i : end[after[i]]]) if after[i] < n else None
        heap = [(r, i) for i in range(n) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        gone = bytearray(n)
        while heap:
            r, i = heapq.heappop(heap)
            if gone[i] or rank(i) != r:
                continue
            j = after[i]
            gone[j], tok[i], end[i], after[i] = 1, r, end[j], after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (i, before[i]):
                if k >= 0 and (new := rank(k)) is not None:
                    heapq.heappush(heap, (new, k))
        return np.array([tok[i] for i in range(n) if not gone[i]], "<u4").tobytes()

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces. Those met lately are remembered, within a bound."""
        if len(self.known) > REMEMBER:
            self.older, self.known = self.known, {}
        found = {p: ids for p in pieces if (ids := self.known.get(p) or self.older.get(p)) is not None}
        todo, raws = [], []
        for p in pieces:
            if p in found:
                continue
            raw = p.encode()
            i = self.ids.get(raw)
            if i is not None:
                found[p] = i.to_bytes(4, "little")
            elif len(raw) > QUERY_BYTES:
                found[p] = self._contract_long(raw)
            else:
                todo.append(p), raws.append(raw)
        made = np.cumsum([0, *(len(r) * (len(r) + 1) // 2 for r in raws)])
        at = 0
        while at < len(todo):
            stop = max(at + 1, int(np.searchsorted(made, made[at] + CONTRACT_ROWS, "right")) - 1)
            found.update(zip(todo[at:stop], self._contract(raws[at:stop])))
            at = stop
        self.known.update(found)
        return [found[p] for p in pieces]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Bytes of each text; ``ends`` says where the ids of each text end.

        Ids are cut into runs where a token begins with a blank, and every distinct run is decoded once.
        """
        if not len(ids):
            return [b""] * len(ends)
        cut = self.blank_first[ids]
        cut[np.concatenate([[0], ends[ends < len(ids)]])] = True
        starts = np.flatnonzero(cut)
        run = np.cumsum(cut) - 1
        place = np.arange(len(ids)) - starts[run]
        mark = _mix(ids.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(32)))
        _, first, which = np.unique(np.add.reduceat(mark, starts), return_index=True, return_inverse=True)
        sizes = np.diff(starts, append=len(ids))
        model = starts[first][which]  # where the first run of the same mark begins
        if (sizes != sizes[first][which]).any() or (ids != ids[model[run] + place]).any():
            first, which = np.arange(len(starts)), np.arange(len(starts))  # two runs share a mark
        lengths = sizes[first]
        own = np.repeat(np.arange(len(first), dtype=np.int32), lengths)
        pos = np.arange(len(own)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        few = ids[starts[first][own] + pos].astype(np.int32)
        rows = {"part": own // RUNS_PER_GROUP, "pos": np.arange(len(few)), "id": few}
        self.db.register("ids", pa.table(rows))
        got = dict(self.db.execute(DECODE).fetchall())
        self.db.unregister("ids")
        joined = "".join(got[i] for i in range(len(got))).encode("latin-1")
        last = np.cumsum(self.sizes[few])[np.cumsum(lengths) - 1].tolist()
        decoded = [joined[a:b] for a, b in zip([0, *last], last)]
        runs = [decoded[i] for i in which.tolist()]
        bounds = np.searchsorted(starts, np.concatenate([[0], ends])).tolist()
        return [b"".join(runs[a:b]) for a, b in zip(bounds, bounds[1:])]


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function (the public splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_coders: dict[tuple, _Coder] = {}


def _coder(tokens: Sequence[bytes]) -> _Coder:
    """One per worker and vocabulary; its tables are built once."""
    key = (len(tokens), hash(tuple(tokens)))
    if key not in _coders:
        _coders.clear()
        _coders[key] = _Coder(tokens)
    return _coders[key]


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together until they hold about GATHER pieces."""
    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += len(batch.column("pieces").flatten())
        if count >= GATHER:
            yield pa.Table.from_batches(held)
            held, count = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _encode_table(coder: _Coder, table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, where each text's ids end)."""
    lists = table.column("pieces").combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    coded = pc.dictionary_encode(lists.flatten())
    pieces = coder.encode_pieces(coded.dictionary.to_pylist())
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
    flat = np.frombuffer(b"".join(pieces), "<u4")
    starts = np.cumsum(sizes) - sizes
    codes = coded.indices.to_numpy()
    lengths = sizes[codes]
    ends = np.cumsum(lengths)
    ids = flat[np.repeat(starts[codes] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]
    per_text = np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
    return ids, np.concatenate([[0], ends])[per_text]


def pieces(docs: DataFrame, id_col: str, text_col: str, pattern: str) -> DataFrame:
    """(id, pieces): every match of the split pattern in each whole text."""
    text_batches(docs.sparkSession)
    text = F.coalesce(quoted(text_col), F.lit(""))
    found = F.regexp_extract_all(text, F.lit(java_pattern(pattern)), F.lit(0))
    return docs.select(quoted(id_col).alias("id"), found.alias("pieces"))


def encode(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, pattern: str) -> DataFrame:
    """(id, ids array<int>) of every text, one row per input row."""
    parts = pieces(docs, id_col, text_col, pattern)
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value)
        for table in _gathered(batches):
            ids, ends = _encode_table(coder, table)
            offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))
            made = pa.table({"id": table.column("id"), "ids": lists})
            yield from made.to_batches(max_chunksize=500)

    kind = parts.schema["id"].dataType.simpleString()
    return parts.mapInArrow(run, f"id {kind}, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(id, bytes) from (id, ids array<int>); null ids decode to no bytes."""
    text_batches(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value)
        for batch in batches:
            lists = batch.column("ids")
            flat = lists.flatten().to_numpy()
            ends = np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
            out = _decode_in_parts(coder, flat, ends)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], ["id", "bytes"])

    kind = encoded.schema["id"].dataType.simpleString()
    return encoded.select("id", "ids").mapInArrow(run, f"id {kind}, bytes binary")


def _decode_in_parts(coder: _Coder, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """Decode so that DuckDB holds about DECODE_ROWS rows at once (a longer text alone)."""
    out: list[bytes] = []
    at = first = 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(ends, first + DECODE_ROWS, "right")))
        last = int(ends[stop - 1])
        out += coder.decode(ids[first:last], ends[at:stop] - first)
        at, first = stop, last
    return out


def digests(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, pattern: str) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encoded, then decoded from the ids, in one pass."""
    parts = pieces(docs, id_col, text_col, pattern)
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value)
        for table in _gathered(batches):
            ids, ends = _encode_table(coder, table)
            starts = np.concatenate([[0], ends[:-1]])
            raw = memoryview(ids.astype("<u4").tobytes())
            sha = lambda x: hashlib.sha256(x).hexdigest()
            made = pa.table(
                {
                    "id": table.column("id"),
                    "n_tokens": pa.array(ends - starts, pa.int64()),
                    "ids_sha256": [sha(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())],
                    "decoded_sha256": [sha(x) for x in _decode_in_parts(coder, ids, ends)],
                }
            )
            yield from made.to_batches()

    kind = parts.schema["id"].dataType.simpleString()
    return parts.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
