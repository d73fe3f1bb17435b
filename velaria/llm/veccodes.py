"""Short codes of vectors: parts are replaced by the nearest entry of a codebook, found over tries of parts.

Components become integers, so all results are exact.  A task takes a block of vectors; for each part position the
distinct parts, in lexicographic order, are a trie whose paths are parts.  The trie is walked depth first, and the
vector of distances to all entries, accumulated over the dimensions of a prefix, is computed once for all parts
below it.  A leaf takes the nearest entry (ties to the lower index) and adds its part, times its weight, to the
sums of that entry.  Subtrees of few leaves are walked in one step, level by level, so that numpy has whole
arrays to work on.  Only sums per position and entry leave a task; codebooks are of fixed size and live on the driver.

Vectors that are null or hold null or non-finite components are left out.  Vectors are filled up with zeros to the
longest kept length, rounded up to a multiple of the number of parts.  Components are held to a bound within which
sums of squares fit 64 bits (about 2^27 divided by the square root of a 64th of the dimension).  The first codebook takes rows
in the order of id, then vector; null ids come last.  Repeated rows count as often as they occur, and fewer rows
than entries give shorter codebooks.  Null labels are one label.  An empty table gives an empty result.  Columns
that aren't named are not read, and named ones are renamed inside.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from velaria.llm import common

SCALE = 256
#: Vectors of a block, leaves of a subtree walked at once, and copies of a label's sum for its rows to meet.
BLOCK, SUBTREE, SALTS = 1 << 15, 1 << 11, 32


class Shape(NamedTuple):
    dims: int
    parts: int

    @property
    def width(self) -> int:
        return self.dims // self.parts

    @property
    def bound(self) -> int:
        return max(1, math.isqrt((1 << 62) // max(self.dims, 1)) // 2)


# ---------------------------------------------------------------------------- the trie


def walk(parts: np.ndarray, entries: np.ndarray, subtree: int = SUBTREE) -> tuple[np.ndarray, np.ndarray]:
    """(nearest entry, distance) of distinct parts in lexicographic order.

    `parts` is the list of leaves; a node of the trie is a range of rows with a common prefix.
    """
    leaves, width = parts.shape
    best, far = np.zeros(leaves, np.int64), np.zeros(leaves, np.int64)
    if not leaves:
        return best, far
    # How many dimensions a row shares with the one before it: where nodes of each depth begin.
    begins = np.ones((width, leaves), bool)
    if width:
        begins[:, 1:] = np.logical_or.accumulate(parts[1:] != parts[:-1], axis=1).T
    stack = [(0, leaves, 0, np.zeros((1, len(entries)), np.int64))]
    while stack:
        low, high, depth, shared = stack.pop()
        if high - low > subtree and depth < width:
            # One node: its children, each with the distances of its longer prefix.
            starts = low + np.flatnonzero(begins[depth, low:high])
            longer = shared + (parts[starts, depth][:, None] - entries[None, :, depth]) ** 2
            ends = np.append(starts[1:], high)
            # Runs of small children go together; the last pushed is walked first.
            cell = _runs(ends - starts, subtree)
            for a, b in reversed(cell):
                if b - a == 1:
                    stack.append((int(starts[a]), int(ends[a]), depth + 1, longer[a : a + 1]))
                else:
                    _descend(parts, entries, begins, int(starts[a]), int(ends[b - 1]), depth + 1, longer[a:b], best, far)
            continue
        _descend(parts, entries, begins, low, high, depth, shared, best, far)
    return best, far


def _runs(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of children that hold `most` leaves at most together; a larger child comes alone."""
    out, start, held = [], 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and held + size > most:
            out.append((start, i))
            start, held = i, 0
        held += size
    out.append((start, len(sizes)))
    return out


def _descend(parts, entries, begins, low, high, depth, shared, best, far) -> None:
    """Walk the nodes of rows low to high, which begin at `depth`, down to their leaves, one level after another."""
    width = parts.shape[1]
    node = np.flatnonzero(begins[depth - 1, low:high]) if depth else np.zeros(1, np.int64)
    for level in range(depth, width):
        starts = np.flatnonzero(begins[level, low:high])
        parent = np.searchsorted(node, starts, side="right") - 1
        shared = shared[parent]
        shared += (parts[low + starts, level][:, None] - entries[None, :, level]) ** 2
        node = starts
    at = slice(low, high)
    best[at] = shared.argmin(axis=1)
    far[at] = shared[np.arange(len(shared)), best[at]]


def distinct_parts(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows in lexicographic order, the place of each row among them, and their weights."""
    rows, width = parts.shape
    if not width:
        return parts[: min(rows, 1)], np.zeros(rows, np.int64), np.array([rows] if rows else [], np.int64)
    order = np.lexsort(parts.T[::-1])
    ranked = parts[order]
    new = np.ones(rows, bool)
    new[1:] = (ranked[1:] != ranked[:-1]).any(axis=1)
    place = np.empty(rows, np.int64)
    place[order] = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    return ranked[starts], place, np.diff(np.append(starts, rows))


# --------------------------------------------------------------------- vectors of a task


def _kept(df: DataFrame, vector: str, key: str, label: str | None) -> DataFrame:
    """Rows that take part: id, vector of doubles, label."""
    tag = F.lit(None).cast("int") if label is None else F.col(f"`{label}`")
    rows = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"), tag.alias("tag"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return rows.where(F.col("vector").isNotNull() & sound)


def _integers(column: pa.Array, shape: Shape) -> np.ndarray:
    """Vectors of a column as rows of integers, filled up with zeros."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), shape.dims), np.int64)
    scaled = np.clip(np.floor(values * SCALE), -shape.bound, shape.bound).astype(np.int64)
    if len(sizes) and (sizes == shape.dims).all():
        return scaled.reshape(len(column), shape.dims)
    row = np.repeat(np.arange(len(sizes)), sizes)
    begin = np.cumsum(sizes) - sizes
    out[row, np.arange(len(values)) - begin[row]] = scaled
    return out


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches put together to blocks of about `most` rows: larger tries share more."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


class Codebooks(NamedTuple):
    """Entries of every part position: integers of shape (parts, entries, width)."""

    entries: np.ndarray
    shape: Shape

    def sha256(self) -> str:
        """Digest of all components in decimal by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()

    def assign(self, vectors: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Per position: distinct parts, their weights, nearest entries and distances, and the place of each row's part."""
        width = self.shape.width
        for position, entries in enumerate(self.entries):
            distinct, place, weights = distinct_parts(vectors[:, position * width : (position + 1) * width])
            best, far = walk(distinct, entries)
            yield position, distinct, weights, best, far, place


def _first(rows: DataFrame, parts: int, size: int) -> Codebooks | None:
    longest = rows.agg(F.max(F.size("vector"))).first()[0]
    if longest is None:
        return None
    shape = Shape(-(-longest // parts) * parts, parts)
    # A fixed number of rows.
    found = rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(size).select("vector").toArrow()
    vectors = _integers(found.column(0).combine_chunks(), shape)
    return Codebooks(np.ascontiguousarray(vectors.reshape(len(vectors), parts, shape.width).transpose(1, 0, 2)), shape)


def _moved(rows: DataFrame, books: Codebooks) -> Codebooks:
    """Every entry replaced by the mean of the parts nearest to it, rounded down; unused ones stay."""
    shape, size = books.shape, books.entries.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((shape.parts, size, shape.width + 1), np.int64)
        for block in _blocks(batches, BLOCK):
            vectors = _integers(block.column(0), shape)
            for position, distinct, weights, best, _, _ in books.assign(vectors):
                weighted = np.column_stack([distinct * weights[:, None], weights])
                for d in range(shape.width + 1):
                    # Sums of integers below 2^53 would be exact in bincount's doubles; these may be larger.
                    np.add.at(sums[position, :, d], best, weighted[:, d])
        used = np.flatnonzero(sums[..., -1].reshape(-1))
        if len(used):
            cells = sums.reshape(-1, shape.width + 1)[used]
            at = np.arange(len(used) + 1) * (shape.width + 1)
            yield pa.RecordBatch.from_arrays([pa.array(used), common.listed(cells.reshape(-1), at)], names=["cell", "sums"])

    added = [F.sum(F.get("sums", F.lit(d))).alias(f"s{d}") for d in range(shape.width + 1)]
    found = rows.select("vector").mapInArrow(run, "cell long, sums array<long>").groupBy("cell").agg(*added).toArrow()
    entries = books.entries.copy().reshape(shape.parts * size, shape.width)
    cells = found.column("cell").to_numpy()
    count = found.column(f"s{shape.width}").to_numpy()
    for d in range(shape.width):
        entries[cells, d] = found.column(f"s{d}").to_numpy() // count
    return Codebooks(entries.reshape(books.entries.shape), shape)


# ------------------------------------------------------------------------ the operator


def fit(df: DataFrame, vector: str = "embedding", key: str = "vec_id", parts: int = 16, size: int = 64, rounds: int = 2) -> Codebooks | None:
    """Codebooks after `rounds` rounds over all kept vectors; None where none is kept."""
    rows = _kept(df, vector, key, None)
    books = _first(rows, parts, size)
    for _ in range(rounds if books else 0):
        books = _moved(rows, books)
    return books


def encode(df: DataFrame, books: Codebooks | None, vector: str = "embedding", key: str = "vec_id", label: str | None = "label") -> DataFrame:
    """id, tag, code (array of entry indexes by position) and error (sum of squared distances)."""
    rows = _kept(df, vector, key, label)
    schema = rows.select("id", "tag").schema.add("code", T.ArrayType(T.IntegerType())).add("error", T.LongType())
    if books is None:
        return df.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, BLOCK):
            vectors = _integers(block.column("vector"), books.shape)
            code = np.zeros((len(vectors), books.shape.parts), np.int32)
            error = np.zeros(len(vectors), np.int64)
            for position, _, _, best, far, place in books.assign(vectors):
                code[:, position] = best[place]
                error += far[place]
            at = np.arange(len(vectors) + 1) * books.shape.parts
            yield pa.RecordBatch.from_arrays(
                [block.column("id"), block.column("tag"), common.listed(code.reshape(-1), at), pa.array(error)],
                names=["id", "tag", "code", "error"],
            )

    return rows.mapInArrow(run, schema)


def decode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """The vector that each code stands for, beside the columns of `rows`."""
    shape = books.shape
    table = F.lit(books.entries.reshape(-1, shape.width).tolist()).cast("array<array<long>>")
    size = books.entries.shape[1]
    whole = F.flatten(F.transform("code", lambda c, i: F.get(table, i * size + c)))
    return rows.withColumn("vector", F.transform(whole, lambda x: x / SCALE))


def with_label_errors(rows: DataFrame) -> DataFrame:
    """`label_error` beside each row: the error of all rows with its label.

    A label may hold a third of the rows: sums are combined before the shuffle, and each is met in `SALTS` copies.
    """
    sums = rows.groupBy("tag").agg(F.sum("error").alias("label_error"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    copies = sums.select(F.col("tag").alias("other"), "label_error", salts.alias("copy"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int"))
    met = salted.join(copies, F.col("tag").eqNullSafe(F.col("other")) & (F.col("salt") == F.col("copy")))
    return met.drop("other", "copy", "salt")


def hex_codes(code: Column, size: int = 64) -> Column:
    """Indexes below `size` in part order, two hexadecimal digits each (more for codebooks of over 256 entries)."""
    digits = max(2, len(f"{size - 1:x}"))
    return F.array_join(F.transform(code, lambda c: F.lower(F.lpad(F.hex(c), digits, "0"))), "")
