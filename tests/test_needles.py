"""Searches by hashed grams, and keys put together from values, against plain versions; with hot keys."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from velaria.functions.views import compact, guard_view
from velaria.operators import guard, needles, secrets

KEY = "sk-proj-AbCdEfGhIjKlMnOpQrStWxYz"


def test_hashes_are_the_same_in_needles_and_texts(spark):
    import numpy as np
    import pyarrow as pa

    texts = ["", "aé🙂b", "xx", "b" * 3000, "aé🙂b"]
    codes = needles.Codes(pa.array([None, *texts]))
    rows, h = codes.grams(2, 5)
    said = [t[i : i + 2] for t in ["", *texts] for i in range(len(t) - 1)]
    assert len(h) == len(said) and len({*zip(said, h.tolist())}) == len(set(said)) == len(set(h.tolist()))
    frame = spark.createDataFrame([(t, 5) for t in set(said)], "t string, s int")
    known = {r.t: r.h for r in frame.select("t", needles.needle_hash("t", "s").alias("h")).collect()}
    assert all(known[t] == x for t, x in zip(said, h.view(np.int64).tolist()))


def test_guard_equals_a_plain_search_with_a_giant_scope(spark):
    rng = random.Random(3)
    parts = ["Ana", "García", "12345678Z", "12·34·56", "x@y.es", "-", "+", "de", "1234", "ß", "ana", "aNa1", "€"]
    make = lambda n: " ".join(rng.choice(parts) for _ in range(rng.randint(1, n)))
    # Scope 0 has a third of the texts and most of the values.
    vault = [(0 if i % 2 else rng.randint(1, 40), f"{make(2)}{'' if i % 3 else i}") for i in range(600)] + [(41, ""), (42, None), (43, "-")]
    texts = [(0 if i % 3 == 0 else rng.randint(1, 45), i, make(4)) for i in range(900)] + [(7, 1000, None), (8, 1001, ""), (50, 1002, "Ana")]
    texts += [(60 + i, 2000 + i, "z " * 200_000 + f"v{i}alue99") for i in range(2)]
    vault += [(60, "v0alue99"), (61, "v2alue99")]
    v = spark.createDataFrame(vault, "scope_id long, value string").repartition(4)
    t = spark.createDataFrame(texts, "scope_id long, text_ord int, text string").repartition(4)
    folded = {r.v: (r.n, r.c) for r in spark.createDataFrame([(x,) for x in {x for _, x in vault} | {x for *_, x in texts}], "v string").select("v", guard_view(F.col("v")).alias("n")).withColumn("c", compact(F.col("n"))).collect()}
    import regex

    def leaks(value, text):
        (n, c), (normal, squeezed) = folded[value], folded[text]
        if not n or normal is None:
            return False
        if len(c) >= 6:
            return c in squeezed
        return regex.search(rf"(?<![\p{{L}}\p{{N}}]){regex.escape(n)}(?![\p{{L}}\p{{N}}])", normal) is not None

    want = {s for s, _, x in texts for o, value in vault if o == s and leaks(value, x)}
    assert {r.scope_id for r in guard.leaking_scopes(t, v).collect()} == want
    assert 60 in want and 61 not in want and 0 in want
    assert guard.leaking_scopes(t.limit(0), v).count() == guard.leaking_scopes(t, v.limit(0)).count() == 0


def test_key_search_with_a_hot_text_and_short_keys(spark):
    keys = [KEY, "sk-ant-api03-" + "Zz" * 20, "ab", "seven77", "0123456789abcdef", ""]
    rng = random.Random(6)
    pieces = [KEY, KEY[10:20], KEY[-4:], KEY[8:12], "Zz" * 5, "****", "…", "ab", "a b", "seven77", "seven7", "6789abcdef", "6789abcde", " ", "."]
    texts = [(i % 400, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 3)))) for i in range(1200)]
    texts += [(1, KEY[-4:] + " and ab " * 3)] * 600 + [(2, None), (3, "x" * 300_000 + KEY[12:22])]
    df = spark.createDataFrame([(i, a, t) for i, (a, t) in enumerate(texts)], "id int, other int, text string").repartition(4)
    table = spark.createDataFrame([(k,) for k in keys], "key string")
    got = {r.id for r in secrets.texts_with_keys(df, table, ["id"]).collect()}
    from velaria.streaming.keywatch import KeyMatcher

    matcher = KeyMatcher.of(tuple(keys))
    assert got == {i for i, (_, t) in enumerate(texts) if t is not None and matcher.found_in(t)}
    assert secrets.texts_with_keys(df, table.limit(0), ["id"]).count() == 0


def test_texts_meet_only_keys_they_hold_a_run_of(spark, monkeypatch):
    # Keys over few signs share all their short pieces.
    rng = random.Random(12)
    make = lambda n: "".join(rng.choice("0123") for _ in range(n))
    secret = [make(24) for _ in range(150)]
    texts = [(i, make(40) + (secret[i][5:16] if i % 3 == 0 else "")) for i in range(150)]
    pairs = []

    def met(*args):
        out = real(*args)
        pairs.append(out.count())
        return out

    real = secrets.search.met
    monkeypatch.setattr(secrets.search, "met", met)
    df = spark.createDataFrame(texts, "id int, text string")
    table = spark.createDataFrame([("sk-proj-" + s,) for s in secret], "key string")
    runs = [{s[j : j + 10] for j in range(15)} for s in secret]
    held = [(i, n) for i, t in texts for n in range(150) if any(t[j : j + 10] in runs[n] for j in range(len(t) - 9))]
    got = {r.id for r in secrets.texts_with_keys(df, table, ["id"]).collect()}
    assert got == {i for i, _ in held} and pairs == [len(held)]


def _joined(values, key):
    """Plain search: every order of every choice of values."""
    return any(
        key in "".join(order) for size in range(1, len(values) + 1) for order in itertools.permutations(values, size)
    )


def test_split_keys_equal_all_permutations(spark):
    rng = random.Random(10)
    keys = ["abcabcab", "aab", "xyzzy", "zz"]
    pool = ["a", "ab", "b", "c", "abc", "bca", "x", "yz", "zy", "xy", "z", "qa", "bq", "ca", "", "zyx", "yzzx"]
    requests = {i: [rng.choice(pool) for _ in range(rng.randint(0, 5))] for i in range(250)}
    rows = [(i, v, "x") for i, values in requests.items() for v in values] + [(900, None, "x")]
    df = spark.createDataFrame(rows, "request_id int, value string, id string")
    table = spark.createDataFrame([(k,) for k in keys], "key string")
    got = {r.request_id for r in secrets.split_over_values(df, table).collect()}
    want = {i for i, values in requests.items() if any(_joined([v for v in values if v], k) for k in keys)}
    assert got == want and 0 < len(want) < 250


@pytest.mark.parametrize("parts", [5, 10, 30])
def test_keys_over_many_values(spark, parts):
    rng = random.Random(parts)
    key = "sk-" + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(45))
    cuts = sorted(rng.sample(range(1, len(key)), parts - 1))
    pieces = [key[a:b] for a, b in zip([0, *cuts], [*cuts, len(key)])]
    noise = [f"n{i}" for i in range(40)]
    whole = ["..." + pieces[0], *pieces[1:-1], pieces[-1] + "!!", *noise]
    missing = [p for i, p in enumerate(whole) if i != parts // 2]
    rng.shuffle(whole)
    # A request with most of all rows beside them.
    hot = [f"{rng.choice(pieces)}{i}" for i in range(2000)]
    rows = [(1, v) for v in whole] + [(2, v) for v in missing] + [(3, v) for v in hot] + [(4, "x" + key + "y")]
    df = spark.createDataFrame(rows, "request_id int, value string").repartition(4)
    table = spark.createDataFrame([(key,)], "key string")
    assert {r.request_id for r in secrets.split_over_values(df, table).collect()} == {1, 4}


def test_split_keys_store_no_more_rows_than_keys_and_values_have(spark, monkeypatch):
    # Values that begin with what many keys end with, or that many keys hold somewhere.
    rng = random.Random(9)
    keys = ["sk-proj-" + "".join(rng.choice("0123456789abcdef") for _ in range(24)) for _ in range(200)]
    rows = [(i, v) for i, key in enumerate(keys) for v in (key[18:], "x", str(i % 10), key[:18])]
    rows += [(1000 + i, v) for i, key in enumerate(keys) for v in (key[18:], "7", key[:17])]
    sizes = []

    def counted(df, name):
        out = stored(df, name)
        sizes.append(out.count())
        return out

    stored = secrets.stored
    monkeypatch.setattr(secrets, "stored", counted)
    df, table = spark.createDataFrame(rows, "request_id int, value string"), spark.createDataFrame([(k,) for k in keys], "key string")
    got = {r.request_id for r in secrets.split_over_values(df, table).collect()}
    assert got == set(range(200)) | {1000 + i for i, key in enumerate(keys) if key[17] == "7"}
    assert max(sizes) <= sum(map(len, keys)) + len(rows)


def test_layers_of_any_depth(spark):
    import json

    text = KEY
    for _ in range(9):
        text = json.dumps([text])
    rows = spark.createDataFrame([(1, text), (2, None)], "id int, text string")
    got = {r.text for r in secrets.text_layers(rows, ["id"]).collect()}
    assert KEY in got and None in got
    assert KEY not in {r.text for r in secrets.text_layers(rows, ["id"], layers=4).collect()}
