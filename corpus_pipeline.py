"""A corpus pipeline of five operators over the ``documents`` table.

Every stage takes and returns the columns of documents; the last returns token ids. ``run``
writes each stage's rows to the shared folder and reads them as the next one's input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, language_id, mixing, ngram_join, substring_dedup
from quarry.scratch import materialize, passing

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Pooled probability below which a language is no language that was learned; far below what clean text scores.
LEAST_SCORE = 0.3
#: Up to so many ids and row keys are broadcast (16 bytes each) to select documents.
BROADCAST_IDS = 1_000_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go (null text, text without a letter, or a score
    below LEAST_SCORE); the others carry the predicted one. Rows are judged each on their own."""
    rows = language_id.annotate(docs.select(*COLUMNS), "lang_pred", "lang_score")
    rows = rows.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("lang_score") >= LEAST_SCORE))
    return rows.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of documents that share 0.8 of their five-word shingles, the one with the
    smallest id stays. Documents without an id or without a word stay. Rows that share an id are
    documents of their own, told apart by their text; of equal ones in a group one stays."""
    with passing(spark) as keep:
        groups = materialize(ngram_join.join_components(docs, width=5, percent=80, keys=True)).where("doc_id is not null and component_key is not null")
        first = (F.col("doc_id") == F.col("component_id")) & (F.col("key") == F.col("component_key"))
        gone = keep(groups.where(~first).select("doc_id", "key").distinct())
        ids = keep(groups.where(first).groupBy("doc_id", "key").count().where("count > 1").select("doc_id", "key"))
    rows = docs.select(*COLUMNS).withColumn("key", ngram_join.row_key())
    rows = rows.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, ["doc_id", "key"], "left_anti")
    if ids.isEmpty():
        return rows.select(*COLUMNS)
    one = rows.join(ids, ["doc_id", "key"], "left_semi").groupBy("doc_id", "key").agg(F.min(F.struct(*COLUMNS[1:])).alias("row")).select("doc_id", "row.*")
    return rows.join(ids, ["doc_id", "key"], "left_anti").select(*COLUMNS).unionByName(one)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words and more stay where they stand first; documents left without a word go.
    Documents that had no word, null text too, stay (null as an empty text), as do rows without an id."""
    rows = substring_dedup.substring_dedup(docs, 20, ("lang", "source", "n_chars"), untouched=True)
    rows = rows.where("n_removed < n_words or n_words = 0")
    n_chars = F.when(F.col("n_removed") == 0, F.col("carry_n_chars")).otherwise(F.char_length("kept_text").cast("long"))
    return rows.select("doc_id", F.col("kept_text").alias("text"), F.col("carry_lang").alias("lang"), F.col("carry_source").alias("source"), n_chars.alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it whole, by its taken words to the nearest time. A source
    takes its words in one shuffled order up to its target, so that only the document where it ends
    is taken in part: words come within half a document of each source's target. Rows with a null
    or repeated id are rows of their own; documents without a word take no part."""
    docs = materialize(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")))
    taken = mixing.mix_sources(docs, key="row").where("taken > 0")
    times = taken.select("row", F.round(F.col("taken") / F.col("size")).cast("int").alias("times")).where("times > 0")
    rows = docs.join(times, "row")
    return rows.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian, 32 bits) of every row, and whether they decode to its text. Null text
    has no ids."""
    coder = bpe.Bpe(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    rows = docs.select("doc_id", "lang", "source", "text", coder.coded(F.col("text")).alias("c"))
    whole = F.col("c.decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return rows.select("doc_id", "lang", "source", bpe.n_tokens(F.col("c.ids")).alias("n_tokens"), "c.ids", whole.alias("round_trip"))


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("mixing", mix),
    ("bpe", tokenize),
]

#: SQL cannot express the recurrent network of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
