"""Names of large scopes and long chains of adjoining names are hidden everywhere."""

from __future__ import annotations

import string

from velaria.functions.spans import SPANS_TYPE
from velaria.operators import propagate
from velaria.session import materialize


def _scanned(spark, rows):
    span = lambda a, b: (a, b, "PERSON", "NER", "MEDIUM")
    made = [(scope, at, text, [dict(zip(("start", "end", "type", "layer", "confidence"), span(*s))) for s in spans]) for scope, at, text, spans in rows]
    plain = "array<struct<start:int,end:int,type:string,layer:string,confidence:string>>"
    df = spark.createDataFrame(made, f"scope_id int, text_ord int, text string, spans {plain}")
    return materialize(df.withColumn("spans", df["spans"].cast(SPANS_TYPE)))


def _listing(names):
    at, spans = 0, []
    for name in names:
        spans.append((at, at + len(name)))
        at += len(name) + 2
    return ", ".join(names), spans


def test_201_names_and_a_limit(spark):
    names = [f"Quirante{a}{b}" for a in string.ascii_lowercase for b in string.ascii_lowercase][:201]
    text, spans = _listing(names)
    scanned = _scanned(spark, [(1, 0, text, spans), (1, 1, f"see {names[200]} there", []), (2, 0, "nobody", [])])
    out, blocked = propagate.propagate(scanned)
    rows = {(r["scope_id"], r["text_ord"]): r for r in out.collect()}
    assert len(rows) == 3 and blocked.count() == 0
    assert [(s["start"], s["end"]) for s in rows[1, 1]["spans"]] == [(4, 4 + len(names[200]))]
    out, blocked = propagate.propagate(scanned, max_names=200)
    assert {r["scope_id"] for r in out.collect()} == {2} and [r["scope_id"] for r in blocked.collect()] == [1]


def test_chain_of_more_than_eight_rounds(spark):
    words = [c + "qz" for c in string.ascii_lowercase[:12]]
    # Each name ends inside the next word, so its right edge is free only when that word is hidden.
    names = [f"{a} {b[0]}" for a, b in zip(words, words[1:])] + [words[-1]]
    text, spans = _listing(names)
    chain = " ".join(words)
    out, _ = propagate.propagate(_scanned(spark, [(1, 0, text, spans), (1, 1, chain, []), (1, 2, " ".join(words[:-1]) + " none", [])]))
    rows = {r["text_ord"]: r["spans"] for r in out.collect()}
    covered = {i for s in rows[1] for i in range(s["start"], s["end"])}
    assert {i for i, c in enumerate(chain) if c != " "} <= covered
    assert rows[2] == []


def _fold_plain(text):
    from velaria.functions.folded import folded_char

    normal, places = "", []
    for i, char in enumerate(text):
        for c in folded_char(char):
            if c != " " or (normal and normal[-1] != " "):
                normal += c
                places.append(i)
    return normal, places


def _plain(names, text, hidden):
    """Every place of the names in a text, by trying all places, round after round."""
    normal, places = _fold_plain(text)
    kept = [i for i, c in enumerate(normal) if c.isalnum()]
    masked = {i for a, b in hidden for i in range(a, b)}
    found = set()
    for name in names:
        needle = _fold_plain(name)[0].rstrip(" ")
        letters = "".join(c for c in needle if c.isalnum())
        if len(letters) >= 6:
            for k in range(len(kept) - len(letters) + 1):
                if "".join(normal[i] for i in kept[k : k + len(letters)]) == letters:
                    found.add((places[kept[k]], places[kept[k + len(letters) - 1]] + 1))
    masked |= {i for a, b in found for i in range(a, b)}
    while True:
        before = len(found)
        for name in names:
            needle = _fold_plain(name)[0].rstrip(" ")
            if 3 <= sum(c.isalnum() for c in needle) < 6:
                for k in range(len(normal) - len(needle) + 1):
                    free = lambda i: not 0 <= i < len(normal) or not normal[i].isalnum() or places[i] in masked
                    if normal[k : k + len(needle)] == needle and free(k - 1) and free(k + len(needle)):
                        found.add((places[k], places[k + len(needle) - 1] + 1))
        masked |= {i for a, b in found for i in range(a, b)}
        if len(found) == before:
            return masked


def test_propagation_equals_a_plain_search_and_folds_in_place(spark):
    import random

    from velaria.functions.folded import folded_views

    rng = random.Random(5)
    pool = ["Zoé", "ZOE", "xio", "Xïo", "Quirante", "quiránte", "anab", "ab c", "ß", "ﬁn", "—", "​", " ", "\t\n", "１２3", "х", "aab", "b", "İ", "½", "🙂"]
    make = lambda n: "".join(rng.choice(pool) + rng.choice(["", " "]) for _ in range(rng.randint(0, n)))
    texts = [make(12) for _ in range(300)] + ["", "   ", "​"]
    views = {r.id: r for r in folded_views(spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "id int, text string"), ["id"]).collect()}
    for i, t in enumerate(texts):
        normal, places = _fold_plain(t)
        letters = [k for k, c in enumerate(normal) if c.isalnum()]
        assert (views[i].normal, views[i].normal_from) == (normal, places)
        assert (views[i].compact, views[i].compact_from) == ("".join(normal[k] for k in letters), [places[k] for k in letters])
    assert views[-1].normal == ""
    names = {scope: [n for n in (make(3).strip() for _ in range(3)) if n] for scope in range(40)}
    rows = []
    for scope, said in names.items():
        text, spans = _listing(said)
        rows += [(scope, 0, text, spans)] + [(scope, k, rng.choice(texts) + rng.choice(said or [""]) + rng.choice(texts), []) for k in range(1, 5)]
    out, _ = propagate.propagate(_scanned(spark, rows))
    checked = 0
    for r in out.collect():
        if r.text_ord == 0:
            continue
        # Only names that stand alone in the first text are searched.
        first, spans = _listing(names[r.scope_id])
        whole = [first[a:b] for a, b in spans if not first[a - 1 : a].isalnum() and not first[b : b + 1].isalnum()]
        want = {i for i in _plain(whole, r.text, []) if r.text[i].isalnum()}
        got = {i for s in r.spans for i in range(s["start"], s["end"]) if r.text[i].isalnum()}
        assert got == want, (r.text, whole)
        checked += bool(want)
    assert checked > 50


def test_a_hundred_thousand_names_in_one_scope(spark):
    from pyspark.sql import functions as F

    names = spark.range(100_000).select(F.concat(F.lit("Quir"), F.conv(F.col("id").cast("string"), 10, 36), F.lit("ante")).alias("name"), "id")
    span = F.struct(
        F.lit(0).alias("start"), F.length("name").alias("end"), F.lit("PERSON").alias("type"), F.lit("NER").alias("layer"), F.lit("MEDIUM").alias("confidence")
    )
    said = names.select(F.lit(1).alias("scope_id"), F.col("id").alias("text_ord"), F.col("name").alias("text"), F.array(span).cast(SPANS_TYPE).alias("spans"))
    # A third of all rows are texts of the same scope; every tenth holds a name in another writing.
    held = F.when(F.col("id") % 10 == 0, F.concat(F.lit("see QUIR-"), F.conv(F.col("id").cast("string"), 10, 36), F.lit(" ante."))).otherwise("see nobody.")
    more = spark.range(50_000).join(names.limit(0), "id", "left").select(
        F.lit(1).alias("scope_id"), (F.col("id") + 1_000_000).alias("text_ord"), held.alias("text"), F.array().cast(SPANS_TYPE).alias("spans")
    )
    out, blocked = propagate.propagate(said.unionByName(more).repartition(8))
    counted = out.filter("text_ord >= 1000000").agg(F.count("*").alias("n"), F.count_if(F.size("spans") > 0).alias("hits")).first()
    assert (counted.n, counted.hits) == (50_000, 5_000) and blocked.count() == 0
