"""Many needles in many texts without shuffling the texts.

Every needle has a gram that any text with the needle must hold.  Hashes of grams are set in a bitmap of bounded
size, which goes to the tasks; a task hashes the spans of its texts that may be grams (rolling, on code points)
and gives out only rows whose hash is set.  Those meet the needles by an equi-join on the hash, and only texts
that met one are read again and compared.  So what is shuffled is bounded by hits and the bitmap's false ones,
whatever the size of a text, and no scope's or key's needles have to fit in one place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType, LongType

from velaria.session import stored

CHUNK_CHARS = 1 << 20
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27
WORD = 1  # the seed of whole words

# ------------------------------------------------------------------------------ hashing

_STEP = 0xD1342543DE82EF95
_BACK = pow(_STEP, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """The first n powers of `base`, kept while they are no more than a chunk's."""
    known = _powers.get(base, np.ones(1, np.uint64))
    if len(known) < n:
        known = np.full(max(n, 1 << 16), np.uint64(base))
        known[0] = 1
        known = np.multiply.accumulate(known)
        if len(known) <= 2 * CHUNK_CHARS:
            _powers[base] = known
    return known[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Codes:
    """Code points of a column of texts one after another; row r has places of[r] to of[r + 1]."""

    def __init__(self, texts: pa.Array):
        plain = pc.fill_null(texts, "")
        codes = np.frombuffer("".join(plain.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = pc.utf8_length(plain).to_numpy(zero_copy_only=False).astype(np.int64)
        self._set(codes, np.concatenate([[0], np.cumsum(sizes)]))

    @classmethod
    def of_codes(cls, codes: np.ndarray, of: np.ndarray) -> Codes:
        out = cls.__new__(cls)
        out._set(codes, of)
        return out

    def _set(self, codes: np.ndarray, of: np.ndarray) -> None:
        self.codes, self.of, n = codes, of, len(codes)
        # Sums over all places before each: a span's hash is a difference, moved back to place 0.
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.codes.astype(np.uint64) + np.uint64(1)) * _power(_STEP, n), out=self._sums[1:])

    def texts(self) -> list[str]:
        whole = self.codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        return [whole[a:b] for a, b in zip(self.of[:-1].tolist(), self.of[1:].tolist())]

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.of) - 1), np.diff(self.of))

    def hashes(self, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
        """64-bit hashes of spans, by what they say, their length and a seed."""
        moved = (self._sums[end] - self._sums[start]) * _power(_BACK, len(self.codes) + 1)[start]
        return mixed(mixed(moved + (end - start).astype(np.uint64)) + np.uint64(seed))

    def grams(self, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, hash) of every span of `size` characters."""
        rows = self.rows()
        start = np.arange(len(rows))
        inside = start + size <= self.of[1:][rows]
        return rows[inside], self.hashes(start[inside], start[inside] + size, seed)

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, start, end) of maximal runs of places where `inside` holds."""
        n = len(inside)
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cuts = self.of[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        first[cuts] = inside[cuts]
        last[cuts - 1] = inside[cuts - 1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        return np.searchsorted(self.of, start, side="right") - 1, start, end


_alnum = np.zeros(0x110000, np.int8)


def alnum(codes: np.ndarray) -> np.ndarray:
    """Which code points are letters or digits; each is asked once in a worker."""
    kind = _alnum[codes]
    if (kind == 0).any():
        for c in np.unique(codes[kind == 0]).tolist():
            _alnum[c] = 1 if chr(c).isalnum() else -1
        kind = _alnum[codes]
    return kind > 0


@pandas_udf(LongType())
def needle_hash(text: pd.Series, seed: pd.Series) -> pd.Series:
    """The hash of a whole text under a seed; nulls hash as empty texts."""
    codes = Codes(pa.array(text, pa.string(), from_pandas=True))
    out = np.zeros(len(text), np.uint64)
    for s in seed.unique().tolist():
        rows = np.flatnonzero(seed.to_numpy() == s)
        out[rows] = codes.hashes(codes.of[rows], codes.of[rows + 1], int(s))
    return pd.Series(out.view(np.int64))


# ------------------------------------------------------------------------------- bitmaps


def bitmap(hashes: DataFrame, column: str = "h") -> np.ndarray:
    """A bitmap of 64-bit hashes; its size follows their number, up to `MOST_BITS` (16 MB)."""
    n, bits = hashes.count(), LEAST_BITS
    while bits < 32 * n and bits < MOST_BITS:
        bits <<= 1
    slot = F.col(column).bitwiseAND(F.lit(bits - 1))
    words = hashes.select(slot.alias("slot")).selectExpr("cast(slot >> 5 as int) word", "shiftleft(1L, cast(slot & 31 as int)) bit")
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 32, np.uint32)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().astype(np.uint32)
    return out


def holds(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes.view(np.uint64) & np.uint64(len(words) * 32 - 1)
    return (words[slot >> np.uint64(5)] >> (slot & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1


def only_maybe(df: DataFrame, ids: DataFrame, by: list[str]) -> DataFrame:
    """Rows whose ids are probably among `ids`; none that is gets lost."""
    return split_maybe(df, ids, by)[0]


def split_maybe(df: DataFrame, ids: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows whose ids are probably among `ids`, rows whose ids surely aren't)."""
    shared = df.sparkSession.sparkContext.broadcast(bitmap(ids.select(F.xxhash64(*by).alias("h")).distinct()))

    @pandas_udf(BooleanType())
    def maybe(h: pd.Series) -> pd.Series:
        return pd.Series(holds(shared.value, h.to_numpy()))

    test = maybe(F.xxhash64(*[F.col(c) for c in by]))
    return df.where(test), df.where(~test)


def only_known(df: DataFrame, hashes: DataFrame, column: str = "h") -> DataFrame:
    """Rows whose hash is probably among `hashes`; none that is gets lost, and nothing is shuffled."""
    shared = df.sparkSession.sparkContext.broadcast(bitmap(hashes))

    @pandas_udf(BooleanType())
    def maybe(h: pd.Series) -> pd.Series:
        return pd.Series(holds(shared.value, h.to_numpy()))

    return df.where(maybe(F.col(column)))


# -------------------------------------------------------------------------------- search

Spans = Callable[[list[Codes]], Iterator[tuple[np.ndarray, np.ndarray]]]


def candidates(texts: DataFrame, keep: list[str], columns: list[Column], spans: Spans, hashes: DataFrame, salt: Column | None = None) -> DataFrame:
    """`keep` and h: for each text the set hashes among those of its spans, once each.

    `spans` gives (row, hash) arrays for the code points of the text columns.  With `salt` (a long), a hash counts
    under its row's salt.  Texts come a million characters at a time; a longer one comes alone.
    """
    shared = texts.sparkSession.sparkContext.broadcast(bitmap(hashes))
    schema = texts.select(*keep).schema
    plan = texts.select(
        *keep, (F.lit(0).cast("long") if salt is None else salt).alias("__salt"), *[c.alias(f"__t{i}") for i, c in enumerate(columns)]
    )
    width, wide, scoped = len(keep), len(columns), salt is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_pieces(batch, width + 1):
                codes = [Codes(part.column(width + 1 + i)) for i in range(wide)]
                salts = part.column(width).to_numpy(zero_copy_only=False).view(np.uint64) if scoped else None
                found = []
                for rows, h in spans(codes):
                    if scoped:
                        h = under(h, salts[rows])
                    hit = holds(shared.value, h)
                    found.append(np.column_stack([rows[hit].astype(np.uint64), h[hit]]))
                pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.uint64)
                took = part.select(range(width)).take(pa.array(pairs[:, 0].astype(np.int64)))
                yield pa.RecordBatch.from_arrays([*took.columns, pa.array(pairs[:, 1].copy().view(np.int64))], names=[*keep, "h"])

    return plan.mapInArrow(run, schema.add("h", "long"))


def placed_words(texts: DataFrame, keep: list[str], column: Column, hashes: DataFrame) -> DataFrame:
    """`keep`, at and word: each maximal run of letters and digits whose hash is probably among `hashes`, and where it begins.

    A run is hashed whole, with `WORD` as its seed.  Words that aren't among them never leave the task.
    """
    shared = texts.sparkSession.sparkContext.broadcast(bitmap(hashes))
    schema = texts.select(*keep).schema
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_pieces(batch, width):
                codes = Codes(part.column(width))
                rows, start, end = codes.runs(alnum(codes.codes))
                hit = np.flatnonzero(holds(shared.value, codes.hashes(start, end, WORD)))
                rows, start, end = rows[hit], start[hit], end[hit]
                said = pa.array([codes.codes[a:b].astype("<u4").tobytes().decode("utf-32-le") for a, b in zip(start.tolist(), end.tolist())], pa.string())
                took = part.select(range(width)).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*took.columns, pa.array((start - codes.of[rows]).astype(np.int32)), said], names=[*keep, "at", "word"])

    return texts.select(*keep, column.alias("__text")).mapInArrow(run, schema.add("at", "integer").add("word", "string"))


def under(h: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """A hash under a salt."""
    return mixed(h ^ salt)


@pandas_udf(LongType())
def under_salt(h: pd.Series, salt: pd.Series) -> pd.Series:
    """A needle's hash under the salt of its scope, as `candidates` makes it."""
    return pd.Series(under(h.to_numpy().view(np.uint64), salt.to_numpy().view(np.uint64)).view(np.int64))


def text_pieces(batch: pa.RecordBatch, first: int, chars: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of about `chars` in the columns from `first` on; a longer row comes alone."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns[first:]:
        sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    cell = np.cumsum(sizes) // chars
    cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def met(found: DataFrame, needles: DataFrame, ids: list[str]) -> DataFrame:
    """Stored pairs of ids and needles that share a hash (`needles` has h)."""
    return stored(found.join(needles, "h").drop("h").distinct(), "met")


def beside_texts(pairs: DataFrame, texts: DataFrame, ids: list[str]) -> DataFrame:
    """`pairs` with the columns of their texts; texts without a pair aren't shuffled."""
    return pairs.join(only_maybe(texts, pairs, ids), ids)
