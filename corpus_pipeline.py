"""Documents made ready for training: each stage works on all that the one before kept.

1. quality rules: documents that fail the base rules or leave their language's perplexity band go
2. near duplicates at a similarity of 0.8 or more: of each component the document with the smallest id stays
3. benchmark decontamination: documents with enough words in benchmark windows go
4. secrets: found spans are replaced in the text, and n_chars is counted anew; every document stays
5. packing: the result is every piece with its sequence and place

Rows with a null id pass the second stage (nothing can name them); rows that repeat an id and a text are one
document to it and stay together.  Null texts have no words, so the first stage lets them go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from velaria.llm import common, credentials, decontaminate, minhash, packing, perplexity, tokens

#: Near copies of the stage; op5 has a threshold of its own.
SIMILAR = (80, 100)


#: Bits of the bitmap of ids that go: 524,288 words at most, whatever the number of ids.
BITMAP_BITS = 1 << 24
#: Rows that go to a Python worker at once: whole rows travel beside their texts, so few are held twice.
BATCH_ROWS = 512


def _rows(docs: DataFrame, *read: str) -> DataFrame:
    """Whole rows in one column beside those an operator reads, so that no name can clash."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    columns = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    return docs.select(columns, *read)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _rows(docs, "text", "lang")
    scored = perplexity.score(rows, perplexity.fit(docs), keep=["__row", "lang"])
    return perplexity.judge(common.written(scored, "scored")).where("kept").select("__row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _rows(docs)
    judged = minhash.near_duplicates(docs.select("doc_id", "text"), threshold=SIMILAR)
    gone = common.written(judged.where("not kept and doc_id is not null").select(F.col("doc_id").alias("id")).distinct(), "gone")
    # Texts that are surely not among those that go aren't shuffled: a bitmap of hashed ids, as a table of a bounded
    # number of words, is met by a broadcast join; no text passes a Python worker.
    key = F.col("__row.doc_id").cast("long")
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(BITMAP_BITS))
    word, bit = (lambda c: F.floor(slot(c) / 32).cast("int")), (lambda c: F.expr("shiftleft(1L, cast(slot % 32 as int))"))
    words = gone.withColumn("slot", slot(F.col("id"))).groupBy(word(F.col("id")).alias("word")).agg(F.bit_or(bit("slot")).alias("bits"))
    words = F.broadcast(common.written(words, "bitmap"))
    marked = rows.withColumn("slot", slot(key)).withColumn("word", F.floor(F.col("slot") / 32).cast("int")).join(words, "word", "left")
    maybe = key.isNotNull() & F.coalesce(F.col("bits").bitwiseAND(bit("slot")) != 0, F.lit(False))
    tested = marked.where(maybe).select("__row", key.alias("id")).join(gone, "id", "left_anti")
    return marked.where(~maybe).select("__row").unionByName(tested.select("__row")).select("__row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = decontaminate.contamination(docs.select("doc_id", "text"), common.table(spark, sf_dir, "benchmark"))
    bad = judged.where("contaminated").select("doc_id", "text_key").distinct()
    own = _rows(docs, "text").select("__row", F.xxhash64("text").alias("key"))
    same = F.col("__row.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("text_key"))
    return own.join(bad, same, "left_anti").select("__row.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = credentials.scan(_rows(docs, "text"), keep=["__row"], clean="__clean", words=credentials.ranked_words(docs))
    values = {c: F.col(f"`__row`.`{c}`") for c in docs.columns}
    values["text"] = F.col("__clean")
    if "n_chars" in values:
        changed = F.col("spans") != ""
        values["n_chars"] = F.when(changed, F.length("__clean").cast(docs.schema["n_chars"].dataType)).otherwise(values["n_chars"])
    return found.select(*[v.alias(c) for c, v in values.items()])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_texts(docs, tokens.tokenizer_path())


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scan", secrets),
    ("packing", packed),
]
# The first, second and last stages are models and searches that SQL doesn't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
