"""The document pipeline: language ID, SimHash near-dedup, passage removal, packing.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and
returns a DataFrame, which is written as Parquet and read again as the next one's
``docs``.  All but the last return the columns of ``documents``.  ``run`` applies them
to the ``documents`` table.

Edge cases: every stage takes null values, empty texts, repeated rows, further columns
and empty tables; see its operator's notes.  ``text`` is never null after the first
stage (null text has no language).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm import hyper_lang, prefix_doubling, simhash_trie, slack_packing
from ledgerlark.llm.queries import tokenizer_file
from ledgerlark.plans.spool import discard, register, scope, shared_path
from ledgerlark.session import ship_package

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter, null texts too, and no others; fills a null ``lang``.

    A text with a letter is in the learned language nearest to it, however far that is;
    a ``lang`` that is given stays.  Where there is nothing to learn from, the same texts
    stay and ``lang`` remains null.
    """
    ship_package(spark)
    docs, letter = docs.select(*COLUMNS), F.col("text").rlike(r"\p{L}")
    if docs.where("lang is not null").where(letter).isEmpty():
        return docs.where(letter)
    found = hyper_lang.identify(docs, F.lit(True))
    # a generated row keeps the filter from working out the prediction a second time
    known = found.select(*COLUMNS, F.inline(F.array("language"))).where(F.col("lang_pred") != hyper_lang.UNKNOWN)
    return known.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: smallest id, no id last.

    Rows are told apart by id and text; of rows with one id a group keeps the one whose
    hash of both is smallest.
    """
    ship_package(spark)
    keyed = docs.select(F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text").alias("row_key"), *COLUMNS)
    groups = simhash_trie.simhash_near_dedup(keyed, id_col="row_key", shingle=4, max_bits=4).select("row_key", "group_fp")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_key")
    first = keyed.select("row_key", "doc_id").distinct().join(groups.distinct(), "row_key").groupBy("group_fp").agg(F.min(order).alias("first"))
    return keyed.join(first.select("first.row_key"), "row_key", "left_semi").dropDuplicates(["row_key"]).select(*COLUMNS)


def passage_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts 50-byte strings that a document with a smaller id holds too.

    A document that has nothing left goes; ``n_chars`` counts what is left.
    """
    ship_package(spark)
    cut = prefix_doubling.cut_repeats(docs.select(*COLUMNS), length=50)
    return cut.where(F.length("text") > 0).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4096 tokens; one row per piece."""
    ship_package(spark)
    return slack_packing.pack(docs, tokenizer_file("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("passage_removal", passage_removal),
    ("packing", packing),
]

#: No stage can be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.

    What a stage spools goes when its result is written, and that when the next one's is;
    what the last stage reads goes with the caller's scope or the session.
    """
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, name)
        with scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        register(spark, path)
        if held:
            discard(spark, held)
        docs, held = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
