"""Configured keys and their recognisable pieces, found in texts by hashed grams and equi-joins on the hits."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from velaria.functions.keyfmt import secret_part
from velaria.functions.spans import stands_in
from velaria.operators import needles as search
from velaria.session import stored

# --- Fixed values: what counts as a piece of a key --------------------------------------------
FRAGMENT = 10
SHOWN = 4
MASK = "*•·.…"
ELLIPSIS = "…"
LITERAL = re.compile(r'"((?:[^"\\]|\\.)*)"', re.S)


def _grams(text: Column, size: int, step: int = 1) -> Column:
    """Pieces of `size` characters at every place, or (step = size) one after the other."""
    pattern = rf"(?s).{{{size}}}" if step == size else rf"(?s)(?=(.{{{size}}}))"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0 if step == size else 1))


RUN, SHOWN_END, LAST, FIRST = range(4)


def key_grams(keys: DataFrame) -> DataFrame:
    """key, secret, provider, kind, h: hashes of grams any text that holds a piece of the key must hold.

    Every run of ten characters of a secret part (shorter ones would be shared by ever more keys), the first 4 and
    last 4 characters of a provider key's, and for a whole key whose secret part is too short for a run, its last 4
    characters (or its first one).
    """
    parts = keys.filter(F.col("key") != "").select("key").distinct().select(
        "key", secret_part(F.col("key")).alias("secret"), F.col("key").startswith("sk-").alias("provider")
    )
    size, none = F.length("secret"), F.array().cast("array<struct<kind:int,gram:string>>")

    def grams(kind, column):
        return F.struct(F.lit(kind).alias("kind"), column.alias("gram"))

    runs = F.when(size >= FRAGMENT, F.transform(_grams(F.col("secret"), FRAGMENT), lambda g: grams(RUN, g))).otherwise(none)
    ends = F.when(
        F.col("provider") & (size >= 2 * SHOWN),
        F.array(grams(SHOWN_END, F.substring("secret", 1, SHOWN)), grams(SHOWN_END, F.substring("secret", -SHOWN, SHOWN))),
    ).otherwise(none)
    long = F.length("key") >= SHOWN
    whole = F.when(
        size < FRAGMENT,
        F.array(F.when(long, grams(LAST, F.substring("key", -SHOWN, SHOWN))).otherwise(grams(FIRST, F.substring("key", 1, 1)))),
    ).otherwise(none)
    exploded = parts.select("*", F.explode(F.array_distinct(F.concat(runs, ends, whole))).alias("g"))
    return exploded.select("key", "secret", "provider", "g.kind", search.needle_hash("g.gram", "g.kind").alias("h"))


def _key_places(kinds: set[int]):
    """Spans of a text that could be grams of these kinds."""

    def places(codes: list[search.Codes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        (text,) = codes
        if RUN in kinds:
            yield text.grams(FRAGMENT, RUN)
        if SHOWN_END in kinds:
            # A shown end of up to nine characters stands right beside a mask.
            mask = np.isin(text.codes, np.array([ord(c) for c in MASK], np.uint32))
            before = np.concatenate([[0], np.cumsum(mask)])
            n, at = len(mask), np.arange(len(mask))
            near = before[np.minimum(at + FRAGMENT, n)] > before[np.maximum(at - FRAGMENT, 0)]
            rows = text.rows()
            start = np.flatnonzero(near & (at + SHOWN <= text.of[1:][rows]))
            yield rows[start], text.hashes(start, start + SHOWN, SHOWN_END)
        if LAST in kinds:
            yield text.grams(SHOWN, LAST)
        if FIRST in kinds:
            yield text.grams(1, FIRST)

    return places


def _holds_run(text: Column, secret: Column) -> Column:
    runs = F.when(F.length(secret) >= FRAGMENT, _grams(secret, FRAGMENT)).otherwise(
        F.array().cast("array<string>")
    )
    return F.exists(runs, lambda r: F.contains(text, r))


def _masked_shape(text: Column, secret: Column) -> Column:
    """4 to 9 characters of one end of the secret beside a mask, with nothing that continues them."""
    size = F.length(secret)
    widths = F.sequence(F.lit(SHOWN), F.greatest(F.least(F.lit(FRAGMENT), size) - 1, F.lit(SHOWN)))
    signs = r"[*•·.…]"
    mask = rf"…|{signs}{signs}"

    def tail(w):
        end = F.substring(secret, size - w + 1, w)
        return stands_in(text, end, rf"(?<={mask})", r"(?![\p{L}\p{N}*•])")

    def head(w):
        start = F.substring(secret, F.lit(1), w)
        return stands_in(text, start, rf"(?<![\p{{L}}\p{{N}}*•·.…])", rf"(?={mask})")

    return (size >= 2 * SHOWN) & F.exists(widths, lambda w: tail(w) | head(w))


def holds_key(text: Column, key: Column, secret: Column, provider: Column) -> Column:
    return (
        F.contains(text, key)
        | _holds_run(text, secret)
        | (provider & _masked_shape(text, secret))
    )


def texts_with_keys(texts: DataFrame, keys: DataFrame, ids, text: str = "text") -> DataFrame:
    """Ids of texts that hold a configured key or a piece of one, once each.

    A task hashes the grams of its texts and gives out those that may be a key's; they meet the keys on the
    hash, and only then is a text compared with that key.  Texts aren't shuffled unless they met one.
    """
    ids = list(ids)
    grams = stored(key_grams(keys), "grams")
    # Four kinds at most.
    kinds = {r.kind for r in grams.select("kind").distinct().collect()}
    found = search.candidates(texts, ids, [F.col(text)], _key_places(kinds), grams)
    pairs = search.met(found, grams.drop("kind"), ids)
    held = holds_key(F.col(text), F.col("key"), F.col("secret"), F.col("provider"))
    return search.beside_texts(pairs, texts.select(*ids, text), ids).filter(held).select(*ids).distinct()


OPENS, WHOLE, CLOSES, INSIDE = range(4)
#: A beginning of a key is only looked up where these many of its first characters are known.
FIRST_TESTS = (1, 4, 8, 16)


def _beginnings(keys: DataFrame) -> DataFrame:
    """kind, said, h: what keys begin with (OPENS), and keys (INSIDE), each once.

    As many rows as the keys have characters, at most.
    """
    places = keys.filter(F.col("key") != "").select("key", F.explode(F.sequence(F.lit(1), F.length("key"))).alias("n"))
    kind = F.when(F.col("n") < F.length("key"), OPENS).otherwise(INSIDE)
    rows = places.select(kind.alias("kind"), F.substring("key", F.lit(1), F.col("n")).alias("said")).distinct()
    return rows.withColumn("h", search.needle_hash("said", "kind"))


def _value_places(sizes: list[int], known: np.ndarray):
    """Spans of a value that could be a beginning of a key at its end, or a key; `known` is a bitmap of both."""
    longest = sizes[-1]

    def begins(text: search.Codes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which spans have first characters that a longer key begins with too."""
        left = np.arange(len(start))
        for n in FIRST_TESTS:
            part = left[end[left] - start[left] > n]
            out = part[~search.holds(known, text.hashes(start[part], start[part] + n, OPENS))]
            left = np.setdiff1d(left, out, assume_unique=True)
        return left

    def places(codes: list[search.Codes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        (text,) = codes
        start, end = text.of[:-1], text.of[1:]
        for n in range(1, longest):
            rows = np.flatnonzero(end - start >= n)
            rows = rows[begins(text, end[rows] - n, end[rows])]
            yield rows, text.hashes(end[rows] - n, end[rows], OPENS)
        rows = text.rows()
        for n in sizes:
            at = np.flatnonzero(np.arange(len(rows)) + n <= text.of[1:][rows])
            at = at[begins(text, at, at + n)]
            yield rows[at], text.hashes(at, at + n, INSIDE)

    return places


def _steps(reached: DataFrame, values: DataFrame, begun: DataFrame, sizes: list[int]) -> DataFrame:
    """request, id, n, kind, before, after: values that lead on from what is reached of a key, or close one.

    A value is put behind what is reached, and the whole is looked up among the beginnings of keys.  So a short value
    costs no more than a long one, however many keys hold it somewhere.
    """
    said = F.concat("before", "start")
    size = F.length(said)
    tried = [
        F.when(F.lit(n).between(F.length("before") + 1, size), F.struct(F.lit(INSIDE).alias("k"), F.substring(said, 1, n).alias("after")))
        for n in sizes
    ]
    whole = F.when(F.col("fits") & (size < sizes[-1]), F.struct(F.lit(OPENS).alias("k"), said.alias("after")))
    pairs = reached.select("request", "before").distinct().join(values, "request")
    rows = pairs.select("request", "id", "n", "before", F.explode(F.filter(F.array(whole, *tried), lambda t: t.isNotNull())).alias("t"))
    rows = rows.select("request", "id", "n", "before", "t.*", search.needle_hash("t.after", "t.k").alias("h"))
    rows = search.only_known(rows, begun).join(begun.select("h", F.col("kind").alias("k"), F.col("said").alias("after")), ["h", "k", "after"])
    return rows.select("request", "id", "n", F.when(F.col("k") == OPENS, WHOLE).otherwise(CLOSES).alias("kind"), "before", "after").distinct()


def split_over_values(values: DataFrame, keys: DataFrame, request: str = "request_id", value: str = "value") -> DataFrame:
    """Requests whose values, some of them joined in some order, hold a configured key.

    What is reached of a key grows value by value: a first value ends with what a key begins with, whole values lead
    from one place in it to the next, a last one begins with the rest.  Values are looked up only behind what their
    own request has reached, so nothing is paired with all keys that hold a short value.  No order is tried out, and
    any number of values may take part.  A value is used once, as often as it occurs: those that fit in more than one
    place of keys are remembered on the way (keys that repeat themselves are the only ones that make many such
    ways).  Null and empty values say nothing.
    """
    begun = stored(_beginnings(keys), "beginnings")
    sizes = [r.n for r in begun.filter(F.col("kind") == INSIDE).select(F.length("said").alias("n")).distinct().orderBy("n").collect()]
    if not sizes:
        return values.select(request).limit(0)
    once = values.filter(F.col(request).isNotNull() & F.col(value).isNotNull() & (F.col(value) != "")).groupBy(request, value).agg(F.count("*").alias("n"))
    once = stored(once.select(F.col(request).alias("request"), F.col(value).alias("value"), F.xxhash64(value).alias("id"), "n"), "values")
    known = search.bitmap(begun)
    found = search.candidates(once, once.columns, [F.col("value")], _value_places(sizes, known), begun)
    true = F.when(F.col("kind") == OPENS, F.endswith("value", F.col("said"))).otherwise(F.contains("value", F.col("said")))
    met = stored(found.join(begun, "h").filter(true).select("request", "id", "n", "kind", "said").distinct(), "met")
    hits = met.filter(F.col("kind") == INSIDE).select("request").distinct()

    # What can be reached at all, whatever is used on the way: each beginning once for a request.
    opens = met.filter(F.col("kind") == OPENS).join(hits, "request", "left_anti")
    opens = opens.select("request", "id", "n", "kind", F.lit("").alias("before"), F.col("said").alias("after"))
    longest = sizes[-1]
    starts = once.select("request", "id", "n", F.substring("value", 1, longest).alias("start"), (F.length("value") < longest).alias("fits"))
    starts = stored(search.only_maybe(starts, opens.select("request").distinct(), ["request"]), "starts")
    edges = new = opens
    reached = seen = stored(opens.select("request", F.col("after").alias("before")).distinct(), "seen")
    while not reached.isEmpty():
        new = stored(_steps(reached, starts, begun, sizes), "steps")
        edges = edges.unionByName(new)
        further = new.filter(F.col("kind") == WHOLE).select("request", F.col("after").alias("before")).distinct()
        reached = stored(further.join(seen, ["request", "before"], "left_anti"), "reached")
        seen = seen.union(reached)
    # Only requests in which some way ends a key are walked.
    ends = edges.filter(F.col("kind") == CLOSES).select("request").distinct()
    edges = stored(edges.join(ends, "request", "left_semi").distinct(), "edges")
    often = edges.groupBy("request", "id").agg((F.count("*") > 1).alias("often"))
    edges = stored(edges.join(often, ["request", "id"]), "edges")

    kind = F.col("kind")
    mark = F.when(F.col("often"), F.array("id")).otherwise(F.array().cast("array<long>"))
    reached = stored(edges.filter(kind == OPENS).select("request", F.col("after").alias("before"), mark.alias("used")).distinct(), "reached")
    free = ~F.col("often") | (F.size(F.filter("used", lambda u: u == F.col("id"))) < F.col("n"))
    whole, closes = edges.filter(kind == WHOLE), edges.filter(kind == CLOSES)
    # What is reached of a key gets longer with every round.
    while not reached.isEmpty():
        closed = reached.join(closes, ["request", "before"]).filter(free).select("request").distinct()
        hits = stored(hits.union(closed).distinct(), "hits")
        further = reached.join(whole, ["request", "before"]).filter(free)
        grown = further.select("request", F.col("after").alias("before"), F.array_sort(F.concat("used", mark)).alias("used")).distinct()
        reached = stored(grown.join(hits, "request", "left_anti"), "reached")
    return hits.select(F.col("request").alias(request))


def _undone(written: str) -> str:
    """A literal's text; one with a broken escape as it stands, so that nothing in it goes unread."""
    try:
        return json.loads(f'"{written}"', strict=False)
    except ValueError:
        return written


def _literals(value: str) -> set[str]:
    """Texts of the string literals in `value`, in JSON or not, and `value` itself unescaped."""
    found = {_undone(match[1]) for match in LITERAL.finditer(value)}
    if "\\" in value and LITERAL.fullmatch(f'"{value}"'):
        found.add(_undone(value))
    return found - {value}


def text_layers(texts: DataFrame, ids, text: str = "text", layers: int | None = None) -> DataFrame:
    """Each text, and the string literals in it with their escapes undone, layer by layer.

    A row's layers are followed where it is, until nothing is new or `layers` deep; what a literal says is never
    longer than the text it stands in.
    """

    def down(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def every(value):
            if not isinstance(value, str):
                return [None]
            out, level, depth = [value], [value], 0
            while level and (layers is None or depth < layers):
                level = [inner for outer in level for inner in sorted(_literals(outer))]
                out += level
                depth += 1
            return out

        for batch in batches:
            # Row by row, so that only one row's layers are held beside the batch.
            for start in range(0, len(batch), 256):
                part = batch.iloc[start : start + 256]
                yield part.assign(**{text: part[text].map(every)}).explode(text)[[*ids, text]]

    fields = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in (*ids, text))
    return texts.select(*ids, text).mapInPandas(down, fields)
