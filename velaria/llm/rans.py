"""Token ids in files, compressed by a static range asymmetric numeral system.

One frequency table, counted over all ids and scaled to 2^20, serves every block.  A block holds whole
documents and is coded by itself in `LANES` interleaved states; every `STEPS` rows of ids it keeps a
checkpoint (the states and the place in the words), from which decoding can start, and a checksum of the
ids up to the next one.  Blocks are rows of Parquet files, so any store that Spark reads will do.  The table
lies beside them with its scale, lanes, steps and checksum, so the folder alone is enough to read an archive.

Layout of a block (little-endian): ids n (u8), checkpoints k (u4), words w (u4), k checksums (u4),
k word places (u4), k x LANES states (u8), w words (u4).  Ids are dealt out to lanes row by row; the last
row is filled up with the table's first symbol.

Null text is an empty one: its only token is the end id.  Null ids of documents come first, repeated ones
keep their rows in some order; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from velaria.llm import common
from velaria.llm.tokens import Encoder

SCALE_BITS = 20
LOWEST = np.uint64(1 << 31)
LANES = 1024
STEPS = 128
BLOCK_IDS = 1 << 18


class Table:
    """Frequencies scaled to 2^20, each symbol that occurs with one at least."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.before = np.cumsum(self.freq) - self.freq
        self.symbol = np.repeat(np.arange(len(freq)), freq.astype(np.int64)).astype(np.uint32)
        self.filler = int(np.flatnonzero(freq)[0]) if freq.any() else 0

    @classmethod
    def scaled(cls, counts: np.ndarray) -> Table:
        """By largest remainders; what rounding up took is given back by the largest symbols."""
        whole, total = 1 << SCALE_BITS, int(counts.sum())
        if not total:
            return cls(np.zeros(len(counts), np.int64))
        exact = counts * (whole / total)
        freq = np.where(counts > 0, np.maximum(1, np.floor(exact)), 0).astype(np.int64)
        order = np.argsort(-(exact - freq), kind="stable")
        order = order[counts[order] > 0]
        spare = whole - int(freq.sum())
        while spare > 0:
            some = order[:spare]
            freq[some] += 1
            spare -= len(some)
        while spare < 0:
            large = np.argsort(-freq, kind="stable")
            large = large[freq[large] > 1][: -spare]
            freq[large] -= 1
            spare += len(large)
        return cls(freq)


def encode(ids: np.ndarray, table: Table, lanes: int = LANES, steps: int = STEPS) -> bytes:
    n = len(ids)
    rows = -(-n // lanes)
    grid = np.full(rows * lanes, table.filler, np.int64)
    grid[:n] = ids
    grid = grid.reshape(rows, lanes)
    freq, before = table.freq[grid], table.before[grid]
    state = np.full(lanes, LOWEST)
    bits, word = np.uint64(SCALE_BITS), np.uint64(32)
    room = np.uint64(63 - SCALE_BITS)
    chunks, emitted, states, places = [], 0, [], []
    for t in range(rows - 1, -1, -1):
        f = freq[t]
        over = state >= (f << room)
        if over.any():
            out = state[over]
            chunks.append(out.astype(np.uint32))
            emitted += len(out)
            state[over] = out >> word
        whole = state // f
        state += whole * ((np.uint64(1) << bits) - f) + before[t]
        if t % steps == 0:
            states.append(state.copy())
            places.append(emitted)
    words = np.concatenate(chunks[::-1]) if chunks else np.zeros(0, np.uint32)
    marks = len(states)
    place = emitted - np.array(places[::-1], np.int64)
    raw = ids.astype("<u4")
    each = steps * lanes
    sums = np.array([zlib.crc32(raw[k * each : (k + 1) * each]) for k in range(marks)], "<u4")
    kept = np.array(states[::-1], "<u8").reshape(marks, lanes)
    return b"".join(
        [struct.pack("<QII", n, marks, len(words)), sums.tobytes(), place.astype("<u4").tobytes(), kept.tobytes(), words.astype("<u4").tobytes()]
    )


def decode(block: bytes, table: Table, lanes: int = LANES, steps: int = STEPS, only: int | None = None) -> np.ndarray:
    """The ids of a block, or those from one checkpoint to the next; a wrong checksum raises ValueError."""
    n, marks, count = struct.unpack_from("<QII", block)
    at = 16
    sums = np.frombuffer(block, "<u4", marks, at)
    places = np.frombuffer(block, "<u4", marks, at + 4 * marks)
    states = np.frombuffer(block, "<u8", marks * lanes, at + 8 * marks).reshape(marks, lanes)
    words = np.frombuffer(block, "<u4", count, at + 8 * marks + 8 * marks * lanes)
    rows, each = -(-n // lanes), steps * lanes
    low, bits, word = np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS), np.uint64(32)
    parts = []
    for k in range(marks) if only is None else [only]:
        here = min(steps, rows - k * steps)
        out = np.empty((here, lanes), np.uint32)
        state, place = states[k].astype(np.uint64), int(places[k])
        for t in range(here):
            slot = state & low
            symbol = table.symbol[slot]
            out[t] = symbol
            state = table.freq[symbol] * (state >> bits) + slot - table.before[symbol]
            need = np.flatnonzero(state < LOWEST)
            if len(need):
                state[need] = (state[need] << word) | words[place : place + len(need)]
                place += len(need)
        ids = out.reshape(-1)[: min(each, n - k * each)]
        if zlib.crc32(ids) != sums[k]:
            raise ValueError("a block's checksum doesn't agree with its ids")
        parts.append(ids)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


# ------------------------------------------------------------------------- Spark jobs


def token_rows(df: DataFrame, path: str, text: str, key: str, end_id: int) -> DataFrame:
    """doc_id, ids (unsigned 16-bit if the vocabulary allows, else 32-bit) and the row's number in its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, nth = Encoder.get(path), 0
        kind = "<u2" if encoder.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        width = np.dtype(kind).itemsize
        for batch in batches:
            for part in common.pieces(batch, 1, common.CHUNK_BYTES):
                ids, of = encoder.encode(pc.fill_null(part.column(1), ""), end_id)
                data = pa.py_buffer(ids.astype(kind).tobytes())
                places = pa.py_buffer((of * width).astype(np.int32).tobytes())
                binary = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, places, data])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.arange(nth, nth + part.num_rows)), pa.array(np.full(part.num_rows, width, np.int32)), binary],
                    names=["doc_id", "nth", "width", "ids"],
                )
                nth += part.num_rows

    rows = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, "doc_id long, nth long, width int, ids binary")


def _unpack(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    raw, of = common.text_bytes(batch.column("ids"))
    width = batch.column("width")[0].as_py()
    return raw.view("<u2" if width == 2 else "<u4"), of // width


def counted(ids: DataFrame) -> np.ndarray:
    """How often each id occurs, over all rows; the table is as long as the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            if batch.num_rows:
                found = np.bincount(_unpack(batch)[0])
                if len(found) > len(total):
                    total = np.concatenate([total, np.zeros(len(found) - len(total), np.int64)])
                total[: len(found)] += found
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["id", "n"])

    rows = ids.select("width", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max((r["id"] for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        out[r["id"]] = r["n"]
    return out


BLOCKS = "part int, block int, before long, doc_ids array<long>, lengths array<long>, payload binary"


def write_blocks(ids: DataFrame, table: Table, parts: int, path: str) -> None:
    """Blocks in ascending order of doc_id: (part, block) is their order, `before` the ids before them in the part."""
    shared = ids.sparkSession.sparkContext.broadcast(table.freq)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = Table(shared.value)
        part, block, before = TaskContext.get().partitionId(), 0, 0
        keys: list[pa.Array] = []
        pieces: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            flat = np.concatenate(pieces)
            cells = [[part], [block], [before], [pa.concat_arrays(keys).to_pylist()], [np.concatenate(sizes).tolist()], [encode(flat, local)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cells, kinds)], names=["part", "block", "before", "doc_ids", "lengths", "payload"]
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            flat, of = _unpack(batch)
            first = 0
            while first < batch.num_rows:
                # Rows up to the one with which the block is full.
                last = int(np.searchsorted(of, of[first] + BLOCK_IDS - held, "left"))
                last = min(max(last, first + 1), batch.num_rows)
                keys.append(batch.column("doc_id").slice(first, last - first))
                pieces.append(flat[of[first] : of[last]].copy())
                sizes.append(np.diff(of[first : last + 1]))
                held += int(of[last] - of[first])
                first = last
                if held >= BLOCK_IDS:
                    yield close()
                    block, before = block + 1, before + held
                    keys, pieces, sizes, held = [], [], [], 0
        if keys:
            yield close()

    dealt = ids.repartitionByRange(parts, "doc_id", "nth").sortWithinPartitions("doc_id", "nth")
    dealt.select("doc_id", "width", "ids").mapInArrow(run, BLOCKS).write.parquet(path)


TABLE = "scale_bits int, lanes int, steps int, crc32 long, freq binary"


def write_table(spark: SparkSession, table: Table, path: str) -> None:
    """The table as one row: frequencies of ids from 0 on as little-endian unsigned 32-bit integers."""
    raw = table.freq.astype("<u4").tobytes()
    spark.createDataFrame([(SCALE_BITS, LANES, STEPS, zlib.crc32(raw), bytearray(raw))], TABLE).write.parquet(path)


def read_table(spark: SparkSession, path: str) -> tuple[Table, int, int]:
    """The table of an archive with its lanes and steps; a wrong checksum or another scale raises ValueError."""
    row = spark.read.schema(TABLE).parquet(path).head()
    raw = bytes(row["freq"]) if row else b""
    if row is None or zlib.crc32(raw) != row["crc32"] or row["scale_bits"] != SCALE_BITS:
        raise ValueError(f"no sound frequency table at {path}")
    return Table(np.frombuffer(raw, "<u4").astype(np.int64)), row["lanes"], row["steps"]


def read_blocks(blocks: DataFrame, table: Table, lanes: int = LANES, steps: int = STEPS) -> DataFrame:
    """Per document from its block: doc_id, part, ids before it in the part, and what `decode` gives, as a checksum."""
    shared = blocks.sparkSession.sparkContext.broadcast(table.freq)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = Table(shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                ids = decode(row.column("payload")[0].as_py(), local, lanes, steps)
                sizes = row.column("lengths").flatten().to_numpy()
                of = np.concatenate([[0], np.cumsum(sizes)])
                raw = ids.astype("<u4", copy=False)
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(of[:-1].tolist(), of[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        row.column("doc_ids").flatten(),
                        pa.array(np.full(len(sizes), row.column("part")[0].as_py(), np.int32)),
                        pa.array(row.column("before")[0].as_py() + of[:-1]),
                        pa.array(sizes),
                        pa.array(crc, pa.int64()),
                    ],
                    names=["doc_id", "part", "before", "n_tokens", "ids_crc32"],
                )

    return blocks.mapInArrow(run, "doc_id long, part int, before long, n_tokens long, ids_crc32 long")


def archive(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", end_id: int = 2, part_ids: int = 1 << 24) -> str:
    """Texts tokenized, counted and written: the folder of the archive, with `blocks` and `table`."""
    spark = df.sparkSession
    ids = common.written(token_rows(df, path, text, key, end_id), "ids", compression="zstd")
    counts = counted(ids)
    table = Table.scaled(counts)
    parts = max(spark.sparkContext.defaultParallelism, -(-int(counts.sum()) // part_ids))
    folder = common.new_folder(spark, "rans")
    write_blocks(ids, table, parts, f"{folder}/blocks")
    write_table(spark, table, f"{folder}/table")
    return folder


def documents_in(spark: SparkSession, folder: str) -> DataFrame:
    """Every document of an archive read back from its files, with the ids before it in the whole archive.

    Totals come as one row for each part, which are as many as tasks wrote.
    """
    table, lanes, steps = read_table(spark, f"{folder}/table")
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    totals = blocks.select("part", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    rows = sorted((r["part"], r["n"]) for r in totals.groupBy("part").agg(F.sum("n").alias("n")).collect())
    starts, total = [], 0
    for part, n in rows:
        starts.append((part, total))
        total += n
    base = spark.createDataFrame(starts, "part int, base long")
    read = read_blocks(blocks, table, lanes, steps).join(F.broadcast(base), "part")
    return read.select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
