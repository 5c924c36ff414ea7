"""Token sequences in training order, as binary shards of fixed stride.

Texts become token ids with an end mark, cut into sequences of ``LENGTH`` ids (the last one filled
up). Sequences are numbered in the order of their table: by file, row and place in the text. A keyed
Feistel permutation, walked along its cycle while it leads outside, turns that number into the
sequence's slot: a bijection of 0 .. n-1 that any reader can work out again. Slots are dealt to
shards by range, exactly ``SHARD_ROWS`` to a shard, so slot s lies in shard s // SHARD_ROWS at offset
s % SHARD_ROWS * stride, and training reads shards one after another, from any slot on.

The texts are tokenised twice: once to count the sequences of each split of the table, whose sums
give every split its first number, and once to write. That costs CPU time and saves keeping all
tokens on disk beside the shuffle and the shards. Both passes check that they see the same splits.

Shards are written by tasks through a name of their own and then renamed, so a retry writes the same
file again. ``write`` leaves shards that are already complete as they are, if told to resume.

Defined cases: a null text is an empty one, and an empty text is one sequence with the end mark only;
null identifiers are handed on; repeated rows are sequences each; no rows give no shards; other
columns of the table, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitag.llm.bpe import read_ranks
from lexitag.llm.common import quoted, text_batches
from lexitag.llm.shared import Rewritten, open_folder
from lexitag.operators.lasting import keep

LENGTH = 512
SHARD_ROWS = 32_768
KEY = 0x5EED
ROUNDS = 6
FILL = 0xFFFF  # an id no vocabulary of at most 65,535 tokens has


@dataclass
class Order:
    """What a reader has to know; stored beside the shards."""

    sequences: int
    length: int
    shard_rows: int
    key: int
    end: int

    @property
    def stride(self) -> int:
        return 2 * self.length

    def place(self, slot: int) -> tuple[int, int]:
        """(shard, byte offset) of a slot."""
        return slot // self.shard_rows, slot % self.shard_rows * self.stride


def _mix(x: np.ndarray) -> np.ndarray:
    """The public splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(numbers: np.ndarray, n: int, key: int) -> np.ndarray:
    """The slots of sequence numbers below ``n``: a keyed bijection of 0 .. n-1."""
    half = np.uint64(max(1, ((max(n, 2) - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = _mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(key % 2**64))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for k in keys:
            left, right = right, left ^ (_mix(right ^ k) & mask)
        return (left << half) | right

    out = once(np.asarray(numbers, np.uint64))
    while (outside := out >= n).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


class _Tokens:
    """One worker's tokenizer."""

    held: dict[int, object] = {}

    @classmethod
    def of(cls, ranks: list[bytes], pattern: str):
        import tiktoken

        key = hash((len(ranks), ranks[0], ranks[-1], pattern))
        if key not in cls.held:
            table, end = {t: i for i, t in enumerate(ranks)}, {"<|end|>": len(ranks)}
            cls.held = {key: tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens=end)}
        return cls.held[key]


def _ids(text: str | None, coder) -> np.ndarray:
    """The ids of a text, no list of Python numbers between. The end mark's name is text like any other."""
    return coder.encode_to_numpy(text or "", disallowed_special=())


def _cut(text: str | None, coder, length: int, end: int) -> np.ndarray:
    """(sequences x length) ids of a text with the end mark, filled up."""
    ids = _ids(text, coder)
    out = np.full((len(ids) // length + 1) * length, FILL, np.uint16)
    out[: len(ids)] = ids
    out[len(ids)] = end
    return out.reshape(-1, length)


def _placed(table: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(file, row, id, text) of a table read from Parquet files."""
    meta = F.col("_metadata")
    return table.select(
        meta["file_path"].alias("file"),
        meta["row_index"].alias("row"),
        quoted(id_col).cast("long").alias("id"),
        quoted(text_col).cast("string").alias("text"),
    )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int] | None, pa.RecordBatch]]:
    """Slices of batches; the first slice of a split of a file comes with (file, first row)."""
    file, row = None, None
    for batch in batches:
        files, rows = batch.column("file").to_pylist(), batch.column("row").to_pylist()
        starts = [i for i in range(len(rows)) if files[i] != (files[i - 1] if i else file) or rows[i] != (rows[i - 1] if i else row) + 1]
        cuts = sorted({0, *starts, len(rows)})
        for a, b in zip(cuts, cuts[1:]):
            yield ((files[a], rows[a]) if a in starts else None), batch.slice(a, b - a)
        file, row = (files[-1], rows[-1]) if rows else (file, row)


def write(
    table: DataFrame,
    id_col: str,
    text_col: str,
    folder: str,
    vocabulary: str,
    pattern: str,
    length: int = LENGTH,
    shard_rows: int = SHARD_ROWS,
    key: int = KEY,
    resume: bool = False,
) -> tuple[Order, DataFrame]:
    """Write all shards; returns the order and the kept index.

    The index is (slot, shard, offset, id, part, n_tokens), a row per sequence; ``part`` counts the
    sequences of a text. ``table`` must be a plain read of Parquet files.
    """
    spark = table.sparkSession
    text_batches(spark)
    ranks = read_ranks(vocabulary)
    end = len(ranks)
    if end >= FILL:
        raise ValueError("ids do not fit 16 bits")
    shared = spark.sparkContext.broadcast(ranks)
    rows = _placed(table, id_col, text_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, found = _Tokens.of(shared.value, pattern), []
        for start, batch in _runs(batches):
            if start:
                found.append([*start, 0])
            for text in batch.column("text").to_pylist():
                found[-1][2] += len(_ids(text, coder)) // length + 1
        if found:
            file, row, n = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(file), pa.array(row, pa.int64()), pa.array(n, pa.int64())], ["file", "row", "n"])

    splits = sorted(map(tuple, keep(rows.mapInArrow(count, "file string, row long, n long")).collect()))  # a row per split
    sums = np.concatenate([[0], np.cumsum([n for *_, n in splits])]).astype(np.int64)
    order = Order(int(sums[-1]), length, shard_rows, key, end)
    bases = spark.sparkContext.broadcast({(f, r): (int(b), n) for (f, r, n), b in zip(splits, sums)})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, base, left = _Tokens.of(shared.value, pattern), 0, 0
        for start, batch in _runs(batches):
            if start:
                if left or start not in bases.value:
                    raise RuntimeError(f"the table was split differently at {start}")
                base, left = bases.value[start]
            cut = [_cut(t, coder, length, end) for t in batch.column("text").to_pylist()]
            sizes = np.array([len(c) for c in cut], np.int64)
            n, every = int(sizes.sum()), np.concatenate(cut)
            of = np.repeat(np.arange(len(cut)), sizes)
            slots = permute(base + np.arange(n), order.sequences, key)
            base, left = base + n, left - n
            if left < 0:
                raise RuntimeError("a split has more sequences than were counted")
            columns = [
                pa.array(slots),
                pa.array((slots // shard_rows).astype(np.int32)),
                batch.column("id").take(pa.array(of)),
                pa.array((np.arange(n) - (np.cumsum(sizes) - sizes)[of]).astype(np.int32)),
                pa.array((every != FILL).sum(axis=1).astype(np.int32)),
                pa.array([r.tobytes() for r in every.astype("<u2")], pa.binary()),
            ]
            names = ["slot", "shard", "id", "part", "n_tokens", "ids"]
            whole = pa.RecordBatch.from_arrays(columns, names)
            for at in range(0, n, 4096):
                yield whole.slice(at, 4096)

    schema = "slot long, shard int, id long, part int, n_tokens int, ids binary"
    shards = max(1, -(-order.sequences // shard_rows))
    dealt = rows.mapInArrow(place, schema).repartitionById(shards, F.col("shard")).sortWithinPartitions("slot")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, begun = None, False
        for batch in batches:
            if not begun and batch.num_rows:
                shard, begun = batch.column("shard")[0].as_py(), True
                if not (resume and complete(folder, order, shard)):
                    file = Rewritten(folder, shard_name(shard))
            if file:
                file.write(b"".join(batch.column("ids").to_pylist()))
            slots = batch.column("slot").to_numpy()
            offset = pa.array(slots % shard_rows * order.stride)
            columns = [batch.column(c) for c in ("slot", "shard")] + [offset] + [batch.column(c) for c in ("id", "part", "n_tokens")]
            yield pa.RecordBatch.from_arrays(columns, ["slot", "shard", "offset", "id", "part", "n_tokens"])
        if file:
            file.done()

    index = keep(dealt.mapInArrow(store, "slot long, shard int, offset long, id long, part int, n_tokens int"))
    about = Rewritten(folder, "order.json")
    about.write(json.dumps(asdict(order)).encode())
    about.done()
    return order, index


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.u16"


def complete(folder: str, order: Order, shard: int) -> bool:
    """Is the shard there in full? It only gets its name when it is."""
    system, path = open_folder(folder)
    rows = min(order.shard_rows, order.sequences - shard * order.shard_rows)
    return system.get_file_info(f"{path}/{shard_name(shard)}").size == rows * order.stride


def read_order(folder: str) -> Order:
    system, path = open_folder(folder)
    with system.open_input_file(f"{path}/order.json") as file:
        return Order(**json.loads(file.read()))


def read_slots(folder: str, start: int = 0, stop: int | None = None) -> Iterator[np.ndarray]:
    """The sequences of slots start .. stop-1, in order, without filling: what a trainer goes on with."""
    order = read_order(folder)
    system, path = open_folder(folder)
    stop = order.sequences if stop is None else min(stop, order.sequences)
    while start < stop:
        shard, offset = order.place(start)
        last = min(stop, (shard + 1) * order.shard_rows)
        with system.open_input_file(f"{path}/{shard_name(shard)}") as file:
            file.seek(offset)
            for _ in range(start, last):
                ids = np.frombuffer(file.read(order.stride), "<u2")
                yield ids[ids != FILL]
        start = last


def read_back(index: DataFrame, order: Order, folder: str) -> DataFrame:
    """The index with ``ids_sha256``, of the stored ids without filling (little-endian 16 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        files: dict[int, object] = {}
        for batch in batches:
            digests = []
            for shard, offset in zip(batch.column("shard").to_pylist(), batch.column("offset").to_pylist()):
                if shard not in files:
                    files = {shard: system.open_input_file(f"{path}/{shard_name(shard)}")}
                ids = np.frombuffer(files[shard].read_at(order.stride, offset), "<u2")
                digests.append(hashlib.sha256(ids[ids != FILL].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], [*batch.schema.names, "ids_sha256"])

    schema = "slot long, shard int, offset long, id long, part int, n_tokens int, ids_sha256 string"
    return index.select("slot", "shard", "offset", "id", "part", "n_tokens").mapInArrow(run, schema)
