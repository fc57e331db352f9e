"""A corpus pipeline: language, near copies, personal data, mixing, tokens.

``STAGES`` lists the stages; each takes (spark, docs, sf_dir) and returns a DataFrame, and each but
the last returns the columns of ``documents``. ``run`` applies them one after the other, and writes
each stage's rows to the shared folder before the next one reads them; a stage's table is deleted
once the next one is written.

Defined results of all stages: documents without an id, and different texts under one id, are
documents of their own; null columns pass as they are; empty tables give empty ones; other columns
than those of ``documents`` are not read.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terracell.llm import bpe, langid, mixing, parity_join, pii
from terracell.llm.common import shared_folder
from terracell.llm.registry import rank_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text is rejected if it has no letter, or if no language reaches this probability.
LEAST_SCORE = 0.3
#: Near copies: five words to a shingle, similarity 0.8 or more.
NEAR = parity_join.Join(ngram=5, num=80, den=100, passes=2)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is known; ``lang`` is filled in where it was null."""
    model = langid.fit(docs)
    judged = langid.identify(docs.select(COLUMNS), model)
    kept = judged.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: the one with the smallest id, none being last.

    Texts without a word are copies of nothing and stay. Different texts without an id, or under
    one id, are different documents; rows of one id and one text are one.
    """
    leading = parity_join.leading(docs, NEAR).withColumnRenamed("row", "_key")
    # The window's shuffle serves the join as well; repeats are left out before it.
    one = Window.partitionBy("_key").orderBy("lang", "source", "n_chars")
    worded = docs.where(parity_join.has_word()).select(*COLUMNS, parity_join.row_key().alias("_key"))
    kept = worded.withColumn("_row", F.row_number().over(one)).where("_row = 1").join(leading, "_key", "left_semi")
    return kept.select(COLUMNS).unionByName(docs.where(~parity_join.has_word()).select(COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its personal data replaced by their kinds."""
    return pii.redact(docs.select(COLUMNS)).withColumn("n_chars", F.length("text").cast("bigint")).select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the proportions of the mix; a pass over a source gives a row a document."""
    return mixing.mixed_documents(docs.select(COLUMNS)).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether they decode to it."""
    rows = docs.select(F.struct("doc_id", "source", "lang", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest")).alias("row"), "text")
    both = bpe.round_trip_documents(rows, rank_file(), public_tokenizers.PATTERN, "row")
    return both.select("row.doc_id", "row.source", "row.lang", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids", (F.sha2("decoded", 256) == F.col("row.digest")).alias("round_trip"))


STAGES = [("language", language), ("near_copies", near_copies), ("personal_data", personal_data), ("mix", mix), ("tokens", tokens)]
#: SQL can express neither the network nor the draws.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = f"{shared_folder(spark)}/{uuid.uuid4()}", None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:  # nothing reads it any more
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
