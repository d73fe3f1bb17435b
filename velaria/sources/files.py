"""Corpora, request logs, manifests and reports as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

DOCUMENT = "name string, text string, annotations array<array<string>>"


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """documents(name, text, annotations array<struct<start,end,label>>) from JSON Lines."""
    raw = spark.read.schema(DOCUMENT).json(path)
    return raw.select(
        "name",
        "text",
        F.transform(
            "annotations",
            lambda a: F.struct(
                a[0].cast("int").alias("start"), a[1].cast("int").alias("end"), a[2].alias("label")
            ),
        ).alias("annotations"),
    )


def corpus_lines(documents: DataFrame) -> DataFrame:
    """One JSON text per document, fields in alphabetical order: (value)."""
    listed = F.transform(
        "annotations",
        lambda a: F.concat(
            F.lit("["), a["start"].cast("string"), F.lit(", "), a["end"].cast("string"), F.lit(", "),
            _json_string(a["label"]), F.lit("]"),
        ),
    )
    return documents.select(
        F.concat(
            F.lit('{"annotations": ['), F.array_join(listed, ", "), F.lit('], "name": '),
            _json_string(F.col("name")), F.lit(', "text": '), _json_string(F.col("text")), F.lit("}"),
        ).alias("value")
    )


def _json_string(value: Column) -> Column:
    """`value` as a JSON string: the native writer's, taken out of a one-field object."""
    wrapped = F.to_json(F.struct(value.alias("v")))
    return F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)


def write_corpus(documents: DataFrame, path: str) -> None:
    corpus_lines(documents).write.mode("errorifexists").text(path)


def _stem(path: Column) -> Column:
    return F.regexp_replace(path, r"\.(?:txt|ann)\z", "")


def read_brat(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects) from a folder of .txt and .ann files (texts kept byte for byte)."""

    def load(pattern, name):
        files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
        return files.select(
            F.regexp_extract(_stem(F.col("path")), r"([^/]+)\z", 1).alias("name"),
            F.decode("content", "UTF-8").alias(name),
        )

    return parse_brat(load("*.txt", "text").join(load("*.ann", "ann"), "name"))


def parse_brat(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects(name, line)) of pairs(name, text, ann).

    Only T lines are read; a discontinuous span gives one annotation per fragment.  A document
    with a line that is malformed or does not say what the text says is rejected whole.
    """
    lines = pairs.select(
        "name", "text", F.posexplode(F.split("ann", r"\r\n|\r|\n")).alias("line", "raw")
    ).filter(F.col("raw").startswith("T"))
    shape = r"\AT[^\t]*\t(\S+) ([0-9]+ [0-9]+(?:;[0-9]+ [0-9]+)*)\t(.*)\z"
    parsed = lines.withColumn("label", F.regexp_extract("raw", shape, 1)).withColumn(
        "ranges",
        F.transform(
            F.filter(F.split(F.regexp_extract("raw", shape, 2), ";"), lambda r: r != ""),
            lambda r: F.struct(
                F.split_part(r, F.lit(" "), F.lit(1)).try_cast("int").alias("start"),
                F.split_part(r, F.lit(" "), F.lit(2)).try_cast("int").alias("end"),
                F.col("label").alias("label"),
            ),
        ),
    )
    said = F.array_join(
        F.transform("ranges", lambda r: F.substring("text", r["start"] + 1, r["end"] - r["start"])), " "
    )
    good = (F.size("ranges") > 0) & (said == F.regexp_extract("raw", shape, 3))
    checked = parsed.withColumn("_good", F.coalesce(good, F.lit(False)))
    rejects = checked.filter("not _good").select("name", (F.col("line") + 1).alias("line"))
    listed = checked.groupBy("name").agg(
        F.flatten(
            F.transform(F.array_sort(F.collect_list(F.struct("line", "ranges"))), lambda x: x["ranges"])
        ).alias("annotations")
    )
    none = F.array().cast("array<struct<start:int,end:int,label:string>>")
    documents = (
        pairs.select("name", "text")
        .join(listed, "name", "left")
        .join(rejects.select("name").distinct(), "name", "left_anti")
        .withColumn("annotations", F.coalesce("annotations", none))
    )
    return documents, rejects


def fingerprints(files: DataFrame, name="name", content="content") -> DataFrame:
    return files.select(
        F.col(name).alias("name"),
        F.octet_length(content).cast("bigint").alias("size"),
        F.md5(content).alias("md5"),
        F.sha2(content, 256).alias("sha256"),
    )


def verify_files(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """name, problem: files missing, not listed, or of another size or hash."""
    a = found.select("name", F.struct("size", "md5", "sha256").alias("f"))
    b = manifest.select("name", F.struct("size", "md5", "sha256").alias("m"))
    problem = (
        F.when(F.col("f").isNull(), "missing")
        .when(F.col("m").isNull(), "not_listed")
        .when(F.col("f.size") != F.col("m.size"), "size")
        .when(F.col("f.md5") != F.col("m.md5"), "md5")
        .when(F.col("f.sha256") != F.col("m.sha256"), "sha256")
    )
    return a.join(b, "name", "full").select("name", problem.alias("problem")).filter("problem is not null")


def admit(requests: DataFrame, limit: int, raw: str = "raw") -> DataFrame:
    """`requests` plus `refused`: what the bytes themselves say, before any body is walked.

    too_large, not_utf8, not_json (also repeated names, NaN and Infinity), not_object; null: go on
    with `velaria.operators.bodies.leaves`, which also refuses names that differ only in case.
    """
    text = F.try_validate_utf8(F.col(raw).cast("string"))
    parsed = F.try_parse_json(text)
    reason = (
        F.when(F.octet_length(raw) > limit, "too_large")
        .when(text.isNull(), "not_utf8")
        .when(parsed.isNull(), "not_json")
        .when(~F.schema_of_variant(parsed).startswith("OBJECT"), "not_object")
    )
    return requests.withColumn("refused", reason)


def write_report(report: DataFrame, path: str, run: str) -> None:
    """One folder per run; types and counts only."""
    report.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").json(path)


def latest_report(reports: DataFrame, suffix: str = "") -> DataFrame:
    """The rows of the latest run whose name ends with `suffix` (run names start with a date)."""
    wanted = reports.filter(F.col("run").endswith(suffix)) if suffix else reports
    last = wanted.agg(F.max("run").alias("run"))
    return wanted.join(F.broadcast(last), "run", "left_semi")


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def keep_latest(rows: DataFrame, keys, order: str) -> DataFrame:
    last = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_r", F.row_number().over(last)).filter("_r = 1").drop("_r")
