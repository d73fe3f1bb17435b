"""Dictionary names against a plain search."""

from __future__ import annotations

import random

import regex

from velaria.operators import names


def test_names_equal_a_plain_search(spark):
    rng = random.Random(7)
    parts = ["Ana", "ana", "García", "de", "la", "O'Neil", "(", ")", "B2", "🙂", "Ñu", "x", "-", ".", "Anabel"]
    listed = [("Ana", "P"), ("Ana", "Q"), ("Ana", "P"), ("Ana de", "P"), ("(Ana)", "P"), ("García", "P"), ("O'Neil", "P"), ("-", "P"), ("", "P"), (None, "P"), ("🙂 x", "P"), ("Ñu", None), ("la.", "P")]
    texts = [(i if i else None, "".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randint(0, 30)))) for i in range(300)]
    texts += [(1000, None), (1001, ""), (1002, "Ana " * 5000), (1003, "z" * 1_100_000 + " Ana de")]
    want = set()
    for key, text in texts:
        for name, label in listed:
            if name and regex.search(r"[\p{L}\p{N}]", name):
                for m in regex.finditer(rf"(?<![\p{{L}}\p{{N}}]){regex.escape(name)}(?![\p{{L}}\p{{N}}])", text or "", overlapped=True):
                    want.add((key, m.start(), m.end(), label, name))
    t = spark.createDataFrame(texts, "k long, text string").repartition(3)
    n = spark.createDataFrame(listed, "name string, label string")
    found = [tuple(r) for r in names.find_names(t, n, ["k"]).select("k", "start", "end", "label", "name").collect()]
    assert len(found) == len(set(found)) and set(found) == want
    assert {None, 1002, 1003} <= {k for k, *_ in found}
    only = names.find_names(t, n.where("name = 'García'"), ["k"])
    assert {tuple(r)[:3] for r in only.collect()} == {w[:3] for w in want if w[4] == "García"}
    assert names.find_names(t, n.limit(0), ["k"]).count() == names.find_names(t.limit(0), n, ["k"]).count() == 0
