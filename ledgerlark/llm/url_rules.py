"""URL filters by a sort-merge range join with nested host and path rules.

A rule ``(host, path, verdict)`` fits its host and all subdomains where the url's path
starts with the rule's.  Its canonical key is the host's labels reversed, each with a
dot, then the path: ``example.net/en/`` is ``net.example./en/``.  A url has one key for
each of its host's own endings, so a rule fits where it is a prefix of one of them, that
is where the key lies in the interval from the rule to the rule and byte FF.  Such
intervals are nested or apart.

Starts and ends of rules and the urls' keys are sorted together, dealt by key and row
over range partitions, so one host, or one url, that holds much of the table is spread.
In a partition the running depth (starts less ends) and, for each depth, the last rule
started there are the stack of active rules; the rule at the current depth is its top,
the longest that fits the key.  Rules that are active where a partition begins are
prefixes of its first key: they are joined to it by equality and start there again.  Of
a url's keys the longest rule wins.

Only DataFrame functions run here.  Keys are cut one character behind the longest rule
and at its number of labels, which changes no match.

Edge cases: null url, and url without ``://``, has empty host and path and no rule; a
host has its port and user with it; an empty path starts with no rule's ``/``; rows are
returned as often as they occur, rows without an id too; rules with null parts, an
empty host, or a path that begins with another character than ``/`` fit no url; of equal rules a block wins; of two rules of one length the one
with the longer host wins; very long urls are kept whole in ``host`` and ``path``; extra
columns are left out; empty tables of urls or rules give an empty result, or urls without
rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, spool

START, URL, END = 0, 1, 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A short list of ``(host, path, verdict)`` as a table."""
    names = ("host", "path", "verdict")
    if not rules:
        return spark.range(0).select(*(F.lit("").alias(c) for c in names))
    return spark.range(1).select(F.inline(F.array(*(F.struct(*(F.lit(x).alias(c) for c, x in zip(names, r, strict=True))) for r in rules))))


def split_url(url) -> tuple:
    """Host (A-Z lower-cased) and path of a url column."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _reversed(host):
    return F.reverse(F.split(host, r"\."))


def _rules(rules: DataFrame) -> DataFrame:
    """``(key, rule, chars, labels, verdict)``, one row per key."""
    host = F.translate(F.col("host"), UPPER, LOWER)
    given = rules.select(host.alias("host"), "path", "verdict").where("host <> '' and verdict is not null and (path = '' or path like '/%')")
    labels = _reversed(F.col("host"))
    return given.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).select(
        F.concat(F.array_join(labels, "."), F.lit("."), "path").cast("binary").alias("key"),
        F.concat("host", "path").alias("rule"),
        F.length(F.concat("host", "path")).alias("chars"),
        F.length("host").alias("host_chars"),
        F.size(labels).alias("labels"),
        "verdict",
    )


def _keys(urls: DataFrame, labels: int, chars: int) -> DataFrame:
    """``(key, row)``: a row for each ending of the host that a rule could have."""
    names = F.slice(_reversed(F.col("host")), 1, labels)
    one = F.explode(F.sequence(F.lit(1), F.size("names"))).alias("level")
    each = urls.where("host <> ''").select("row", "path", names.alias("names")).select("row", "path", "names", one)
    key = F.concat(F.array_join(F.slice("names", F.lit(1), F.col("level")), "."), F.lit("."), F.col("path"))
    return each.select(F.substring(key, 1, chars + 1).cast("binary").alias("key"), "row")


def _events(urls: DataFrame, rules: DataFrame, labels: int, chars: int) -> DataFrame:
    """Starts and ends of rules, and urls' keys, with the range partition they are in."""
    what = F.struct("chars", "host_chars", "rule", "verdict").alias("what")
    none = F.lit(None).cast("long").alias("row")
    starts = rules.select("key", F.lit(START).alias("kind"), none, what)
    ends = rules.select(F.concat("key", F.unhex(F.lit("FF"))).alias("key"), F.lit(END).alias("kind"), none, what)
    nothing = F.lit(None).cast(starts.schema["what"].dataType).alias("what")
    seen = _keys(urls, labels, chars).select("key", F.lit(URL).alias("kind"), "row", nothing)
    every = starts.unionByName(ends).unionByName(seen)
    return every.repartitionByRange(partitions(urls.sparkSession), "key", "kind", "row").withColumn("part", F.spark_partition_id())


def _carried(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Starts of the rules that are active where a partition begins: prefixes of its first key."""
    first = events.groupBy("part").agg(F.min(F.struct("key", "kind")).alias("first")).select("part", "first.*")
    cut = first.select("part", "kind", F.length("key").alias("whole"), F.col("key").alias("from"), F.explode(F.sequence(F.lit(1), F.length("key"))).alias("n"))
    prefixes = cut.where((F.col("n") < F.col("whole")) | (F.col("kind") != START)).select("part", F.substr("from", F.lit(1), F.col("n")).alias("key"))
    what = F.struct("chars", "host_chars", "rule", "verdict").alias("what")
    return prefixes.join(rules, "key").select("key", F.lit(START).alias("kind"), F.lit(None).cast("long").alias("row"), what, "part")


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """``(id_col, host, path, rule, verdict)`` per row; ``default`` where no rule fits.

    ``rules`` has ``host``, ``path`` and ``verdict``.
    """
    spark = pages.sparkSession
    host, path = split_url(F.col(url_col).cast("string"))
    urls, _ = spool(pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), host.alias("host"), path.alias("path")), "urls")
    known, _ = spool(_rules(rules), "rules")
    size = known.agg(F.max("labels").alias("labels"), F.max(F.length("key")).alias("chars")).first()
    if size["labels"] is None:
        return urls.select(F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    events, _ = spool(_events(urls, known, size["labels"], size["chars"]), "events")
    swept = events.unionByName(_carried(events, known)).repartitionByRange(partitions(spark), "part")
    here = Window.partitionBy("part").orderBy("key", "kind", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.when(F.col("kind") == START, 1).when(F.col("kind") == END, -1).otherwise(0)
    top = Window.partitionBy("part", "depth").orderBy("key", "kind", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stack = F.last(F.when(F.col("kind") == START, F.col("what")), ignorenulls=True).over(top)
    met = swept.withColumn("depth", F.sum(step).over(here)).withColumn("top", stack).where((F.col("kind") == URL) & F.col("top").isNotNull())
    won = met.groupBy("row").agg(F.max("top").alias("top"))
    return urls.join(won, "row", "left").select(
        F.col("id").alias(id_col), "host", "path", F.col("top.rule").alias("rule"), F.coalesce("top.verdict", F.lit(default)).alias("verdict")
    )
