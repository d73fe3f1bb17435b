"""The pipeline's stages on a small table: what goes, what stays, and the columns."""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from velaria.llm import common  # noqa: E402


def test_stages(spark, tmp_path):
    rng_words = [f"w{i % 97}x{i % 13}" for i in range(2000)]
    text = lambda a, n=60: " ".join(rng_words[a + i * 3 % 400] for i in range(n))
    rows = [(i, " ".join(f"t{(i * 7 + k * (i + 3)) % 991}" for k in range(60)), "en", "s", 5) for i in range(30)]
    rows += [(100, rows[3][1], "en", "s", 5), (101, "too few", "en", "s", 5), (102, None, "en", "s", 5)]
    rows += [(103, text(5) + " token = 0123456789abcdef0123456789abcdef", "en", "s", 5), (104, text(900), None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    item = " ".join(rows[8][1].split()[10:40])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, str(tmp_path)), "stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    assert 101 not in kept[0] and 102 not in kept[0]
    assert (3 in kept[1]) and 100 not in kept[1]
    assert 8 in kept[1] and 8 not in kept[2]
    assert set(kept[3]) == set(kept[2]) and all("0123456789abcdef" not in t for t in kept[3].values())
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in packed.collect()} == set(kept[3])
