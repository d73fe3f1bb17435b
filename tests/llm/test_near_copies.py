"""Near copies between 0.80 and 0.85 go in the pipeline's stage; op5 keeps its own threshold."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from velaria.llm import minhash


@pytest.mark.parametrize("threshold, shape", [((85, 100), (48, 8, 384, 0.74)), ((80, 100), (64, 7, 448, 0.68))])
def test_bands_of_a_threshold(threshold, shape):
    bands = minhash.Bands.of(threshold)
    assert bands == shape
    assert (1 - (threshold[0] / threshold[1]) ** bands.rows) ** bands.count < 3e-7


def test_stage_drops_copies_from_four_fifths(spark):
    rng = random.Random(8)
    rows = []
    for i in range(30):
        words = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        two, three = list(words), list(words)
        two[20] = two[60] = "changed"
        three[20] = three[50] = three[80] = "changed"
        # 86 of 106 shingles are shared (0.811), and 81 of 111 (0.730).
        rows += [(3 * i, " ".join(words)), (3 * i + 1, " ".join(two)), (1000 + i, " ".join(three))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    alone = docs.where("doc_id < 1000")
    left = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, alone, "").collect()}
    assert left == {3 * i for i in range(30)}
    far = docs.where("doc_id % 3 = 0 and doc_id < 1000 or doc_id >= 1000")
    assert corpus_pipeline.near_dedup(spark, far, "").count() == 60
    assert minhash.near_duplicates(alone).where("kept").count() == 60
