"""Best-fit packing of token sequences, by hierarchical residual rounds.

Each task tokenizes its texts and packs their pieces best-fit, longest first.  Nearly full bins leave;
underfull ones travel on as items (with their members) to the next round, in fewer and fewer groups, each
of a bounded number of items.  Rounds end with one group, or when a round closes next to no bin any more.
No piece is dropped and none is cut but those longer than a bin.

Null text is an empty one: its only token is the end id.  Repeated rows and null ids are packed like any
other row; an empty table gives an empty result; other columns of the input are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from velaria.llm import common
from velaria.llm.tokens import Encoder

BIN = (
    "fill long, members array<struct<doc_id: bigint, piece: int, start: bigint, length: bigint, ids_crc32: bigint>>, "
    "done boolean"
)
MEMBER_ARROW = pa.struct(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
)
#: Items that one task packs at once.
MOST_ITEMS = 200_000


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item: longest first, each into the open bin it leaves least room in.

    Open bins are kept by their room, and a bit set of rooms finds the tightest one at once.
    """
    bins = np.empty(len(sizes), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    present, opened = 0, 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = present >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            chosen = rooms[room].pop()
            if not rooms[room]:
                present &= ~(1 << room)
        else:
            room, chosen, opened = capacity, opened, opened + 1
        bins[i] = chosen
        left = room - size
        if left:
            rooms[left].append(chosen)
            present |= 1 << left
    return bins


def _packed(sizes: np.ndarray, members: pa.ListArray, capacity: int, slack: int) -> pa.RecordBatch:
    """Items (each a list of pieces) put together in bins."""
    bins = best_fit(sizes, capacity)
    order = np.argsort(bins, kind="stable")
    count = int(bins.max(initial=-1)) + 1
    counts = pc.list_value_length(members).to_numpy(zero_copy_only=False).astype(np.int64)
    per_bin = np.bincount(bins, weights=counts, minlength=count).astype(np.int64)
    fill = np.bincount(bins, weights=sizes, minlength=count).astype(np.int64)
    flat = pc.take(members, pa.array(order)).flatten()
    offsets = np.concatenate([[0], np.cumsum(per_bin)]).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(fill), pa.ListArray.from_arrays(pa.array(offsets), flat), pa.array(fill >= capacity - slack)],
        names=["fill", "members", "done"],
    )


def _first_round(text: str, key: str, path: str, end_id: int, capacity: int, slack: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.get(path)
        waiting: list[pa.StructArray] = []
        held = 0

        def close() -> Iterator[pa.RecordBatch]:
            pieces = pa.concat_arrays(waiting)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(pieces) + 1, dtype=np.int32)), pieces)
            sizes = pieces.field("length").to_numpy(zero_copy_only=False)
            packed = _packed(sizes, lists, capacity, slack)
            for at in range(0, packed.num_rows, 10_000):
                yield packed.slice(at, 10_000)

        for batch in batches:
            for part in common.pieces(batch, 1, 2 * common.CHUNK_BYTES):
                texts = pc.fill_null(part.column(1), "")
                waiting.append(_cut(part.column(0), *encoder.encode(texts, end_id), capacity))
                held += len(waiting[-1])
                if held >= MOST_ITEMS:
                    yield from close()
                    waiting, held = [], 0
        if held:
            yield from close()

    return run


def _cut(keys: pa.Array, ids: np.ndarray, of: np.ndarray, capacity: int) -> pa.StructArray:
    """Pieces of every row: the first takes what full ones leave."""
    total = np.diff(of)
    count = -(-total // capacity)
    row = np.repeat(np.arange(len(total)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    head = total - (count - 1) * capacity
    length = np.where(nth == 0, head[row], capacity)
    start = np.where(nth == 0, 0, head[row] + (nth - 1) * capacity)
    data = ids.astype("<u4", copy=False).view(np.uint8)
    at = of[row] + start
    crc = np.fromiter(
        (zlib.crc32(data[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist())), np.int64, len(row)
    )
    return pa.StructArray.from_arrays(
        [pc.take(keys, pa.array(row)), pa.array(nth.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)],
        fields=list(MEMBER_ARROW),
    )


def _later_round(capacity: int, slack: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        held = 0

        def close() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(waiting).combine_chunks()
            packed = _packed(
                whole["fill"].to_numpy(), whole["members"].combine_chunks().cast(pa.list_(MEMBER_ARROW)), capacity, slack
            )
            for at in range(0, packed.num_rows, 10_000):
                yield packed.slice(at, 10_000)

        for batch in batches:
            waiting.append(batch)
            held += batch.num_rows
            if held >= MOST_ITEMS:
                yield from close()
                waiting, held = [], 0
        if held:
            yield from close()

    return run


def pack_texts(
    df: DataFrame,
    path: str,
    text: str = "text",
    key: str = "doc_id",
    capacity: int = 2048,
    end_id: int = 0,
    slack: int = 8,
    fan_in: int = 8,
    least_gain: float = 0.01,
) -> DataFrame:
    """Every piece with its sequence and its place there.

    A bin with at most `slack` tokens of room is nearly full.  Each round has `fan_in` times fewer groups;
    rounds also end when less than `least_gain` of the underfull bins went away and one group is too many items.
    """
    spark = df.sparkSession
    rows = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    step = common.written(
        rows.mapInArrow(_first_round("text", "doc_id", path, end_id, capacity, slack), BIN), "bins"
    )
    groups = max(1, rows.rdd.getNumPartitions())
    closed = [step.where("done")]
    left = step.where("not done")
    n = left.count()
    while n > 1:
        groups = max(1, -(-groups // fan_in), -(-n // MOST_ITEMS))
        step = common.written(
            left.repartition(groups).mapInArrow(_later_round(capacity, slack), BIN), "bins"
        )
        closed.append(step.where("done"))
        left, before = step.where("not done"), n
        n = left.count()
        if groups == 1 or (groups <= -(-before // MOST_ITEMS) and before - n < least_gain * before):
            break
    closed.append(left)
    out = closed[0]
    for other in closed[1:]:
        out = out.unionByName(other)
    # A task numbers its own bins; 2^33 of them fit.
    numbered = out.select(F.monotonically_increasing_id().alias("sequence_id"), "members")
    placed = numbered.select("sequence_id", F.posexplode("members").alias("nth", "m"), "members")
    before = F.aggregate(
        F.slice("members", F.lit(1), F.col("nth")), F.lit(0).cast("long"), lambda total, m: total + m["length"]
    )
    return placed.select("m.*", "sequence_id", before.alias("offset"))
