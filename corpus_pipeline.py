"""Corpus pipeline: language ID, near duplicates, decontamination, source mix, token file.

Each stage is a function (spark, docs, sf_dir) -> DataFrame whose result is written as Parquet and read as the next
one's docs; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm import decontaminate, jaccard, langid, mixing, tokenfile
from veilspan.llm.common import discard, fresh, materialize, sized


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null or empty text and text without a letter (`und`). Texts whose language
    is ambiguous stay. Where no row is labelled the model has no language: every text with a letter stays."""
    model = langid.fit(docs)
    if not model["langs"]:
        return docs.where(langid.has_letter(F.col("text"))).select(*docs.columns)
    name = fresh(docs, "lang")
    x = docs.withColumn(name, langid.predict(model, F.col("text"))["lang"])
    return x.where(F.col(name) != "und").select(*docs.columns)


def row_hash(docs: DataFrame) -> Column:
    """64-bit hash of all columns of a row; nulls count."""
    return F.xxhash64(*docs.columns, *[F.col(c).isNull() for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents with five-word shingles at 0.8 or more, the least id stays, once (null last).
    Rows are told apart by all columns: those of one id, or of a null id, stay if their components differ."""
    ids = docs.select("doc_id")
    if ids.where("doc_id is null").isEmpty() and ids.groupBy("doc_id").count().where("count > 1").isEmpty():
        found = jaccard.near_groups(docs, k=5, num=80, den=100)
        gone = materialize(found.where("id <> component_id").select(F.col("id").alias("doc_id")).distinct(), "near-gone")
        discard(*found._inputs)
        return docs.join(sized(gone), "doc_id", "left_anti").select(*docs.columns)
    row = fresh(docs, "row")
    x = docs.withColumn(row, row_hash(docs))
    groups = materialize(jaccard.near_groups(x, key=row, k=5, num=80, den=100), "near")
    named = groups.select(F.col("id").alias(row), "component_id").distinct().join(x.select(row, "doc_id").distinct(), row)
    least = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", row)).alias("least"))
    kept = x.join(sized(materialize(least.select(F.col("least")[row].alias(row)), "near-kept")), row, "left_semi")
    return kept.dropDuplicates([row]).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark windows of ten words are cut out; a document of which no word is left goes."""
    hits = decontaminate.contamination(F.col("text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), cut=True)
    h = fresh(docs, "hits")
    x = docs.withColumn(h, hits).where((F.col(h)["n_hit"] == 0) | (F.col(h)["n_hit"] < F.col(h)["n_words"]))
    x = x.withColumn("text", F.coalesce(F.col(h)["rest"], F.col("text")))
    return x.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights 1, 2, 3, ...; a document taken more than once is repeated. Copies are dealt to rows, not
    ids: a null id is an id like others, and rows of one id have copies of their own."""
    row, ident, copies, n, r, copy = (fresh(docs, x) for x in ("row", "id", "copies", "n", "r", "copy"))
    x = docs.withColumn(row, row_hash(docs))
    per = mixing.pareto_mix(x, carry=row).groupBy("id", row).agg(F.sum("copies").alias(copies), F.count("*").alias(n)).where(F.col(copies) > 0)
    x = x.join(per.select(F.col("id").alias(ident), F.col(row).alias(r), copies, n), F.col("doc_id").eqNullSafe(F.col(ident)) & (F.col(row) == F.col(r)))
    # Rows equal in all columns are one, with the copies of all.
    x = x.where(F.col(n) == 1).unionByName(x.where(F.col(n) > 1).dropDuplicates([ident, row]))
    return x.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*docs.columns)


def token_file(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in range-coded segments, described from what reading them back gives."""
    import public_tokenizers

    table = tokenfile.write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return tokenfile.read_tokens(table).withColumnRenamed("id", "doc_id")


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("source_mix", source_mix), ("token_file", token_file)]
#: Language ID, near duplicates, Pareto sampling and range coding aren't expressible in SQL; tests/llm holds their
#: operators against brute-force versions and the stages against small planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
