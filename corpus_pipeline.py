"""A corpus pipeline over `documents`: low-quality texts go, one document of each group of copies stays, benchmark passages go,
sources are mixed to their weights, and the mix becomes token files. Each stage is written as Parquet and read by the next one.

Stages decide by row: by doc_id where it names rows, else by a row number. Columns of the input keep their values, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.llm import contamination, minhash, mixing, quality, tokenfiles
from boxloom.llm.common import Tables, new_path
from boxloom.llm.queries import END_ID, tokenizer_file

#: The classifier, the min-max signatures and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def keyed(docs: DataFrame, tables: Tables) -> tuple[DataFrame, str]:
    """docs and the column that tells its rows apart: doc_id, or where ids repeat or lack, a row number that is written down with them."""
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        return docs, "doc_id"
    key = "row_number"
    while key in docs.columns:
        key += "_"
    return tables.stored(docs.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps. Null and blank texts go."""
    own = {c: c if c in ("doc_id", "text") else f"column_{k}" for k, c in enumerate(docs.columns)}
    kept = quality.classified(docs.select(*(F.col(f"`{c}`").alias(a) for c, a in own.items()))).where("keep")
    return kept.select(*(F.col(a).alias(c) for c, a in own.items()))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group linked on five-word shingles at similarity 0.8."""
    tables, own = Tables(spark), Tables(spark)
    rows, key = keyed(docs, tables)
    copies = tables.stored(minhash.near_duplicates(rows, id_col=key, tables=own).where("not kept").select(key), "copies")
    own.drop()
    return rows.join(copies, key, "left_anti").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten-word window of a benchmark item."""
    tables = Tables(spark)
    rows, key = keyed(docs, tables)
    found = contamination.contamination(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=key)
    hit = tables.stored(found.where("n_hit > 0").select(key), "hit")
    return rows.join(hit, key, "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a document is there as often as it is taken, not at all or up to twice."""
    tables = Tables(spark)
    rows, key = keyed(docs, tables)
    return mixing.repeated(rows, id_col=key).select(docs.columns)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and per document what reading them back gives."""
    path = new_path(spark, "tokens")
    tokenfiles.write_tokens(docs, path, tokenizer_file("word_bpe_49k.json"), END_ID)
    return tokenfiles.read_checksums(spark, path)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("token_files", token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`: a row per document of the mix with its place and checksum in the token files."""
    docs, tables = spark.read.parquet(f"{sf_dir}/documents.parquet"), Tables(spark)
    for name, stage in STAGES:
        docs = tables.stored(stage(spark, docs, sf_dir), name)
        tables.drop(but=(docs,))
    return docs
