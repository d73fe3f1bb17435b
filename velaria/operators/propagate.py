"""Names found once are hidden wherever else they appear in their scope.

Names are folded and hashed, under their scope, and set in a bitmap.  A task folds its texts with the places kept
(`functions.folded`), hashes the spans of every length that names have, and gives out the places that are set; they
meet the names by an equi-join on two 64-bit hashes.  So neither the texts nor a scope's names are gathered:
a scope may have any number of either.

Names of six or more letters and digits are found anywhere, also inside words; shorter ones as words.  What is
hidden counts as an edge, so hiding one short name may free the next: what was found in a text is settled in rounds over its
places alone, until nothing changes.  Names of fewer than three letters and digits aren't looked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from velaria.functions.folded import Folded
from velaria.functions.spans import SPANS_TYPE, char_at, piece
from velaria.operators import needles as search
from velaria.operators.policy import hides
from velaria.operators.resolve import resolve
from velaria.session import stored

# --- Fixed values -----------------------------------------------------------------------------
MIN_COMPACT = 6  # from here on, names are found inside words too
MIN_LETTERS = 3
PLACES = ArrayType(
    StructType().add("start", IntegerType()).add("end", IntegerType()).add("type", StringType())
)
LONG, SHORT = 11, 12
SECOND = 100  # added to a seed for the second hash
FORMS = StructType().add("normal", StringType()).add("compact", StringType())


def is_whole(text: Column, start: Column, end: Column) -> Column:
    """No letter or digit touches the range: it is not a fragment of a longer word."""
    alnum = F.lit(r"[\p{L}\p{N}]")
    return ~F.rlike(char_at(text, start - 1), alnum) & ~F.rlike(char_at(text, end), alnum)


@pandas_udf(FORMS)
def _forms(values: pd.Series) -> pd.DataFrame:
    views = Folded(pa.array(values, pa.string(), from_pandas=True))
    return pd.DataFrame({"normal": [t.rstrip(" ") for t in views.normal.texts()], "compact": views.compact.texts()})


def _needles(values: DataFrame, scope: str) -> DataFrame:
    """type, kind, size, h, g: what is searched for, hashed twice under its scope."""
    letters = F.length("f.compact")
    rows = values.select(scope, "type", _forms("value").alias("f")).filter(letters >= MIN_LETTERS)
    long = letters >= MIN_COMPACT
    rows = rows.select(
        scope, "type", F.when(long, F.lit(LONG)).otherwise(F.lit(SHORT)).alias("kind"), F.when(long, F.col("f.compact")).otherwise(F.col("f.normal")).alias("said")
    ).distinct()
    h, g = (search.under_salt(search.needle_hash("said", F.col("kind") + more), F.xxhash64(scope)) for more in (0, SECOND))
    return rows.select(scope, "type", "kind", F.length("said").alias("size"), h.alias("h"), g.alias("g"))


def _appearances(rows: DataFrame, scope: str, text: str, kind: int, needles: DataFrame) -> DataFrame:
    """_row, start, end, type, left, right: every appearance of names of one kind.

    `left` and `right` are the places of the letters or digits that touch it, -1 where none does.
    """
    wanted = needles.filter(F.col("kind") == kind)
    # As many rows as names have lengths.
    sizes = sorted(r.size for r in wanted.select("size").distinct().collect())
    shared = rows.sparkSession.sparkContext.broadcast(search.bitmap(wanted))
    named = search.only_maybe(rows.select("_row", scope, text), wanted.select(scope).distinct(), [scope])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in search.text_pieces(batch, 2):
                views = Folded(part.column(2))
                codes, origin = (views.compact, views.compact_from) if kind == LONG else (views.normal, views.normal_from)
                salts = part.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
                row_of, place = codes.rows(), np.arange(len(codes.codes))
                found = []
                for size in sizes:
                    start = place[place + size <= codes.of[1:][row_of]]
                    h = search.under(codes.hashes(start, start + size, kind), salts[row_of[start]])
                    start, h = start[hit := search.holds(shared.value, h)], h[hit]
                    found.append((start, np.full(len(start), size), h))
                start, size, h = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
                row = row_of[start]
                g = search.under(codes.hashes(start, start + size, kind + SECOND), salts[row])
                touch = search.alnum(codes.codes)

                def beside(at, inside):
                    at = np.where(inside, at, 0)
                    return np.where(inside & touch[at], origin[at], -1) if len(origin) else np.zeros(0, np.int64)

                left, right = beside(start - 1, start > codes.of[:-1][row]), beside(start + size, start + size < codes.of[1:][row])
                ends = origin[start + size - 1] + 1 if len(start) else start
                out = [part.column(0).take(pa.array(row)), *[pa.array(c.astype(np.int32)) for c in (origin[start], ends, left, right)]]
                out += [pa.array(c.astype(np.uint64).view(np.int64)) for c in (h, g)]
                yield pa.RecordBatch.from_arrays(out, names=["_row", "start", "end", "left", "right", "h", "g"])

    schema = "_row long, start int, end int, left int, right int, h long, g long"
    places = named.select("_row", F.xxhash64(scope).alias("_salt"), text).mapInArrow(run, schema)
    return places.join(wanted.select("type", "h", "g"), ["h", "g"]).select("_row", "start", "end", "type", "left", "right").distinct()


TOUCHING = ArrayType(
    StructType().add("start", IntegerType()).add("end", IntegerType()).add("type", StringType()).add("left", IntegerType()).add("right", IntegerType())
)


@pandas_udf(PLACES)
def _settled(found: pd.Series, hidden: pd.Series, shown: pd.Series) -> pd.Series:
    """Appearances that stand alone, in rounds: what they hide frees their neighbours, what stays visible doesn't."""

    def ranges(listed):
        return np.array([(r["start"], r["end"]) for r in listed], np.int64).reshape(-1, 2)

    def one(listed, hides_, shows):
        places = np.array([(r["start"], r["end"], r["left"], r["right"]) for r in listed], np.int64).reshape(-1, 4)
        size = int(max(places.max(initial=0), ranges(hides_).max(initial=0), ranges(shows).max(initial=0))) + 2
        masked, visible = np.zeros(size, bool), np.zeros(size, bool)
        for a, b in ranges(hides_):
            masked[a:b] = True
        for a, b in ranges(shows):
            visible[a:b] = True
        # The last place stands for no neighbour at all.
        masked[-1] = True
        start, end, left, right = places.T
        alone, changed = np.zeros(len(places), bool), True
        while changed:
            new = masked[left] & masked[right] & ~alone
            alone |= new
            changed = False
            for a, b in zip(start[new].tolist(), end[new].tolist()):
                fresh = ~visible[a:b] & ~masked[a:b]
                changed |= bool(fresh.any())
                masked[a:b] |= fresh
        return [{n: listed[i][n] for n in ("start", "end", "type")} for i in np.flatnonzero(alone).tolist()]

    return pd.Series([one(*row) for row in zip(found, hidden, shown)])


def _as_names(places: Column) -> Column:
    return F.transform(
        places,
        lambda p: F.struct(
            p["start"].alias("start"), p["end"].alias("end"), p["type"].alias("type"),
            F.lit("NER").alias("layer"), F.lit("MEDIUM").alias("confidence"),
        ),
    ).cast(SPANS_TYPE)


def propagate(
    scanned: DataFrame, scope="scope_id", text="text", policy=None, max_names: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(scanned with every appearance of its hidden names, blocked scopes).

    Scopes with more than `max_names` names are blocked (None: no scope is).  Rows without an appearance keep
    their place; null texts hold nothing.
    """
    columns = scanned.columns
    rows = stored(scanned.withColumn("_row", F.monotonically_increasing_id()), "scanned")
    one = rows.select(scope, text, F.explode_outer("spans").alias("s")).filter("s is not null")
    whole = one.filter(
        (F.col("s.layer") == "NER")
        & hides(F.col("s.type"), policy)
        & is_whole(F.col(text), F.col("s.start"), F.col("s.end"))
    )
    values = stored(
        whole.select(scope, F.col("s.type").alias("type"), piece(F.col(text), F.col("s.start"), F.col("s.end")).alias("value")).distinct(), "names"
    )
    blocked = values.limit(0).select(scope, F.lit("detector_failed").alias("reason"))
    if max_names is not None:
        many = values.groupBy(scope).agg(F.count("*").alias("n")).filter(F.col("n") > max_names)
        blocked = stored(many.select(scope, F.lit("detector_failed").alias("reason")), "blocked")
        values, rows = (x.join(blocked.select(scope), scope, "left_anti") for x in (values, rows))
    needles = stored(_needles(values, scope), "needles")

    long = _appearances(rows, scope, text, LONG, needles)
    rows = _with(rows, long.groupBy("_row").agg(F.collect_list(F.struct("start", "end", "type")).cast(PLACES).alias("_more")), text)

    short = _appearances(rows, scope, text, SHORT, needles)
    found = short.groupBy("_row").agg(F.collect_list(F.struct("start", "end", "type", "left", "right")).cast(TOUCHING).alias("_found"))

    def ranges(test):
        return F.transform(
            F.filter("spans", test),
            lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("type")),
        )

    own = search.only_maybe(rows, found.select("_row"), ["_row"]).select(
        "_row", ranges(lambda s: hides(s["type"], policy)).alias("_hidden"), ranges(lambda s: ~hides(s["type"], policy)).alias("_shown")
    )
    alone = found.join(own, "_row").select("_row", _settled("_found", "_hidden", "_shown").alias("_more")).filter(F.size("_more") > 0)
    return _with(rows, alone, text).select(*columns), blocked


def _with(rows: DataFrame, more: DataFrame, text: str) -> DataFrame:
    """`rows` with places (_row, _more) added to their spans; rows that surely have none aren't shuffled."""
    more = stored(more, "places")
    some, none = search.split_maybe(rows, more.select("_row"), ["_row"])
    joined = some.join(more, "_row", "left").withColumn("_more", F.coalesce("_more", F.array().cast(PLACES)))
    merged = joined.withColumn("spans", _merged(text)).drop("_more")
    return stored(merged.unionByName(none), "scanned")


def _merged(text: str) -> Column:
    merged = resolve(F.concat("spans", _as_names(F.col("_more"))), F.col(text))
    return F.when(F.size("_more") == 0, F.col("spans")).otherwise(merged)
