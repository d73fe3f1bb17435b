"""The size of op7's model as the query fits it."""

from __future__ import annotations

from velaria.llm import recurrent


def test_outputs_and_width_of_the_query(spark):
    rows = [(i, " ".join(f"w{(i * 50 + k) % 4500}" for k in range(50))) for i in range(180)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    vocabulary, network, _ = recurrent.fit(docs, warm_documents=5)
    assert network.width == 16
    assert len(set(vocabulary.output.tolist()) - {vocabulary.other}) == min(4095, len(vocabulary.words))
    assert len(vocabulary.words) > 4000
