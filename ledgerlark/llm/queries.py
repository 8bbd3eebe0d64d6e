"""The numbered queries over the test tables, and SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    cross_polytope,
    e8_lattice,
    exact_whitening,
    hyper_lang,
    kneser_ney,
    license_digest,
    preference_chat,
    prefix_doubling,
    simhash_trie,
    slack_packing,
    unigram_pieces,
    url_rules,
    word_runs,
)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer's file."""
    return str(public_tokenizers.path(name))


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def _remainder(n: int):
    """crc32 of doc_id as text, modulo n; rows without an id count as 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % n, F.lit(0))


def op1_cross_polytope_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest neighbours of every fiftieth vector."""
    return cross_polytope.nearest(_embeddings(spark, sf_dir), F.col("vec_id") % 50 == 0, k=5)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into sequences of at most 4096 tokens."""
    packed = slack_packing.pack(_documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"), capacity=4096, end_id=1)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kneser-Ney score of every document, learned from nine tenths of them."""
    docs = _documents(spark, sf_dir)
    taught = _remainder(10) != 0
    model = kneser_ney.train(docs.where(taught))
    return kneser_ney.score(docs, model, taught)


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that documents with smaller ids hold in a 50-byte string, removed."""
    return prefix_doubling.remove_repeats(_documents(spark, sf_dir), length=50)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from two thirds of them."""
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang")
    out = hyper_lang.identify(docs, _remainder(3) != 1)
    return out.select("doc_id", (_remainder(3) == 1).alias("held_out"), "language.lang_pred", "language.score")


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors linked at cosine 0.9 or more."""
    return e8_lattice.embedding_near_dedup(_embeddings(spark, sf_dir), threshold=0.9)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licence that a document's whole text is, and the known notices among its lines."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    whole = license_digest.scan(docs, unit="text").select("doc_id", F.lit(-1).alias("line"), "licence")
    lines = license_digest.scan(docs, unit="line").select("doc_id", F.col("place").alias("line"), "licence")
    return whole.unionByName(lines)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents encoded to pieces and decoded again."""
    return unigram_pieces.round_trips(_documents(spark, sf_dir), tokenizer_file("piece_bpe_32k.model"))


def op9_chat_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation against a counterpart whose last answer echoes the turn before it."""
    chosen = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return preference_chat.preference_pairs(chosen, preference_chat.echo_rejections(chosen))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked by SimHash fingerprints at 4 or fewer differing bits."""
    out = simhash_trie.simhash_near_dedup(_documents(spark, sf_dir), shingle=4, max_bits=4)
    return out.select("doc_id", "fingerprint", "component_id")


#: Rules of the url query: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url by nested host and path rules."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_rules.filter_urls(pages, url_rules.rule_table(spark, URL_RULES))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First four whitened components of every vector.

    ``deviation`` is null where it is beyond a long; the operator has it as a decimal.
    """
    out = exact_whitening.whiten(_embeddings(spark, sf_dir), components=4)
    each = out.select("vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", F.col("deviation").try_cast("long").alias("deviation"),
        "whitened", F.get("explained", F.col("at")).alias("explained"), "identity_error",
    )


def _let(value, then):
    """``then`` of a column that is worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _repeated_tail(text, h):
    """The text's words, joined by blanks, with a stretch repeated to the end that ``h`` names.

    Word ``i`` from ``a`` on becomes word ``a + (i - a) % p``; a text without words stays.
    """
    g = F.floor(h / 10)

    def repeat(words, a, p):
        copies = F.array_repeat(F.slice(words, a + 1, p), F.ceil((F.size(words) - a) / p).cast("int"))
        return F.concat(F.slice(words, F.lit(1), a), F.slice(F.flatten(copies), F.lit(1), F.size(words) - a))

    def from_word(words, a):
        p = F.floor((F.size(words) - a) / (3 + g % 8)) + 1
        return _let(p.cast("int"), lambda p: repeat(words, a, p))

    def from_words(words):
        a = (g % F.size(words)).cast("int")
        return F.when(F.size(words) > 0, _let(a, lambda a: from_word(words, a))).otherwise(words)

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.array_join(_let(words, from_words), " ")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words in every document, and what is left without the repeats.

    In every tenth document, by crc32 of its id, the tail is made periodic first; a
    document without an id stays as it is.
    """
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string"))
    planted = docs.withColumn("text", F.when(h % 10 == 0, _repeated_tail(F.col("text"), h)).otherwise(F.col("text")))
    out = word_runs.periodic_runs(planted, shortest=24, repeats=3)

    def first(a, b):
        left, right = a["length"] * b["period"], b["length"] * a["period"]
        later = F.when(a["start"] != b["start"], F.signum(a["start"] - b["start"])).otherwise(F.signum(a["period"] - b["period"]))
        return F.when(left > right, -1).when(left < right, 1).otherwise(later).cast("int")

    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), "")
    most = out.withColumn("most", F.get(F.array_sort("runs", first), F.lit(0)))
    return most.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "most.start", "most.length", "most.period",
        F.floor(1000 * F.col("most.length") / F.col("most.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    q.__name__: q
    for q in (
        op1_cross_polytope_ann,
        op2_best_fit_packing,
        op3_lm_scoring,
        op4_suffix_array_dedup,
        op5_language_id,
        op6_embedding_near_dedup,
        op7_license_scan,
        op8_sentencepiece,
        op9_chat_preference,
        op10_simhash_near_dedup,
        op11_url_filters,
        op12_embedding_whitening,
        op13_periodic_runs,
    )
}

_URL_FILTERS = """
WITH cut AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
    FROM pages
),
parts AS (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM cut
),
judged AS (
    SELECT page_id, host, path,
           CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
                WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
                WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
                WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
    FROM parts
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""

ORACLE: dict[str, str] = {"op11_url_filters": _URL_FILTERS}
