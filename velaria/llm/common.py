"""What the operators share: folders all executors see, clash-free columns, and words of Arrow text.

Words are found on the UTF-8 bytes of an Arrow column with numpy, a few megabytes at a time, so memory
in a task is bounded by the longest single text.  Words are compared by 64-bit hashes of their bytes:
a random weight for each byte value, times a power of an odd constant for its place, mixed.
"""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

CHUNK_BYTES = 4 << 20

# -------------------------------------------------------------- folders and columns


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="velaria-shared-")


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; only a local session without it gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _own_folder()


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """`df` as a Parquet table in the shared folder: lost executors lose nothing, readers prune columns."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def added(schema: T.StructType, new: str | T.StructType) -> tuple[list[str], T.StructType]:
    """The columns that stay beside new ones, and the schema of both.

    An input column whose name clashes with a new one (in any case) gives way to it.
    """
    new = T.StructType.fromDDL(new) if isinstance(new, str) else new
    taken = {f.name.lower() for f in new}
    kept = [f for f in schema if f.name.lower() not in taken]
    return [f.name for f in kept], T.StructType([*kept, *new])


@functools.cache
def _trim() -> Callable[[int], int] | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Free memory goes back to the system: workers are used again, and what one stage freed the next may need."""
    pa.default_memory_pool().release_unused()
    if _trim():
        _trim()(0)


def map_text(
    df: DataFrame,
    text: str,
    new: str,
    make: Callable[..., Callable[[pa.Array, dict], list[pa.Array]]],
    keep: list[str] | None = None,
    extra: tuple[str, ...] = (),
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """One pass over the rows: `make()` is called in the task and gives chunk(texts, extras) -> new columns.

    `keep` names the input columns carried along (default all).  `extra` columns are handed to the
    function too.  Texts arrive without nulls (null as empty), a few megabytes at a time.
    """
    kept, schema = added(df.select(*keep).schema if keep is not None else df.schema, new)
    plan = df.select(
        *[F.col(f"`{c}`") for c in kept],
        F.col(f"`{text}`").alias("__text"),
        *[F.col(f"`{c}`").alias(f"__x{i}") for i, c in enumerate(extra)],
    )
    width, names = len(kept), [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = make()
        for batch in batches:
            for part in pieces(batch, width, chunk_bytes):
                texts = part.column(width)
                plain = pc.fill_null(texts, "") if texts.null_count else texts
                extras = {c: part.column(width + 1 + i) for i, c in enumerate(extra)}
                out = chunk(plain, extras | {"__is_null": pc.is_null(texts)})
                yield pa.RecordBatch.from_arrays([*part.columns[:width], *out], names=names)
        give_back()

    return plan.mapInArrow(run, schema)


def pieces(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of `batch` of about `most` bytes in the given text column; a longer text comes alone."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    cell = np.cumsum(lengths.astype(np.int64)) // most
    cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


# ------------------------------------------------------------------ bytes and words


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column one after another, and where each row begins (rows + 1 places)."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, places, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    offsets = offsets.astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def _class_table(separators) -> np.ndarray:
    out = np.ones(256, bool)
    out[list(separators)] = False
    return out


#: True for bytes of words: all but space and 0x09 to 0x0D.
SPACED = _class_table([0x20, *range(0x09, 0x0E)])
#: True for ASCII letters, digits and all bytes beyond ASCII.
ALNUM = _class_table([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_WEIGHT = splitmix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = np.uint64(0xD1342543DE82EF95)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n or more powers of the step, kept between calls up to a fixed length."""
    global _powers
    if len(_powers) >= n:
        return _powers
    grown = np.full(max(n, 1024), _STEP)
    grown[0] = 1
    grown = np.multiply.accumulate(grown)
    if len(grown) <= 1 << 20:
        _powers = grown
    return grown


class Words:
    """Words of a chunk: byte places `start` and `end`, and `of`: where each row's words begin."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
        self.raw, self.offsets = raw, offsets
        mask = inside[raw]
        first = mask.copy()
        first[1:] &= ~mask[:-1]
        last = mask.copy()
        last[:-1] &= ~mask[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(raw))]
        first[cuts] = mask[cuts]
        last[cuts - 1] = mask[cuts - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.of = np.searchsorted(self.start, offsets)
        self._mask = mask

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.of)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.of) - 1), np.diff(self.of))

    def hashes(self) -> np.ndarray:
        return span_hashes(self.raw[self._mask], self.end - self.start)

    def text(self, i: int) -> str:
        return self.raw[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")


def _span_hashes(flat: np.ndarray, lengths: np.ndarray, begin: np.ndarray) -> np.ndarray:
    place = np.arange(len(flat)) - np.repeat(begin, lengths)
    h = _WEIGHT[flat]
    h *= powers(int(lengths.max()) + 1)[place]
    h = np.add.reduceat(h, begin)
    return splitmix(h + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def span_hashes(flat: np.ndarray, lengths: np.ndarray, most: int = 1 << 18) -> np.ndarray:
    """64-bit hashes of byte spans that lie one after another in `flat`, made about `most` bytes at a time."""
    if not len(lengths):
        return np.zeros(0, np.uint64)
    begin = np.cumsum(lengths) - lengths
    cuts = [0, *(np.flatnonzero(np.diff(begin // most)) + 1).tolist(), len(lengths)]
    edges = [*begin[cuts[:-1]].tolist(), len(flat)]
    out = np.empty(len(lengths), np.uint64)
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        out[a:b] = _span_hashes(flat[edges[i] : edges[i + 1]], lengths[a:b], begin[a:b] - edges[i])
    return out


def words_of(texts: pa.Array, inside: np.ndarray = SPACED, lower: bool = False) -> Words:
    raw, offsets = text_bytes(texts)
    return Words(LOWER[raw] if lower else raw, offsets, inside)


def sum_rows(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Sums over each row's values; `of` has where they begin (rows + 1 places)."""
    kind = values.dtype if values.dtype.kind in "uf" else np.int64
    total = np.concatenate([np.zeros(1, kind), np.cumsum(values, dtype=kind)])
    return total[of[1:]] - total[of[:-1]]


def listed(values: np.ndarray, of: np.ndarray) -> pa.Array:
    """An Arrow list column from values one after another."""
    return pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), pa.array(values))
