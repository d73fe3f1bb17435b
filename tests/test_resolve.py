"""Overlap resolution against a brute-force placement, character by character."""

import random

from velaria.functions.spans import SPANS_TYPE
from velaria.functions.tables import ENTITY_TYPES, LAYERS
from velaria.operators.resolve import resolve
from pyspark.sql import functions as F


def expected(spans, text):
    unique = sorted(set(spans))

    def inside(s):
        side = s[3] == "NER"
        return any(
            (o[3] == "NER") == side and o[0] <= s[0] and s[1] <= o[1] and o[:2] != s[:2] for o in unique
        )

    order = sorted(
        unique,
        key=lambda s: (
            s[3] == "NER", inside(s), LAYERS.index(s[3]), s[0] - s[1], s[0], ENTITY_TYPES.index(s[2]), s[4],
        ),
    )
    owner = [None] * len(text)
    kept = []
    for s in order:
        free = [i for i in range(s[0], s[1]) if owner[i] is None]
        pieces, run = [], []
        for i in free:
            if run and i != run[-1] + 1:
                pieces.append(run)
                run = []
            run.append(i)
        if run:
            pieces.append(run)
        whole = len(free) == s[1] - s[0]
        for piece in pieces:
            if whole or any(text[i].isalnum() for i in piece):
                kept.append((piece[0], piece[-1] + 1, *s[2:]))
                for i in piece:
                    owner[i] = s
    return sorted(kept)


def test_random_overlaps_match_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for n in range(150):
        text = "".join(rng.choice("ab1 -é") for _ in range(40))
        spans = []
        for _ in range(rng.randint(0, 9)):
            start = rng.randrange(38)
            end = min(40, start + rng.randint(1, 14))
            spans.append(
                (start, end, rng.choice(("ES_DNI", "EMAIL", "PHONE", "PERSON")), rng.choice(LAYERS), rng.choice(("HIGH", "MEDIUM")))
            )
        rows.append((n, text, spans))
    df = spark.createDataFrame(rows, f"n int, text string, spans {SPANS_TYPE}")
    got = df.select("n", resolve(F.col("spans"), F.col("text")).alias("r")).collect()
    for row in got:
        _, text, spans = rows[row.n]
        assert [tuple(s) for s in row.r] == expected(spans, text), rows[row.n]
