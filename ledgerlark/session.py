"""Spark session settings used by tests, the bench and the CLI helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

# Settings every ledgerlark job relies on:
#  - UTC session time zone: lead times and month buckets are computed on wall-clock
#    timestamps (timestamp_ntz); a fixed zone keeps micros arithmetic exact.
#  - AQE with skew-join splitting and partition coalescing: hot vendors / months /
#    offers are split at runtime instead of landing in one task.
#  - Arrow for the pandas UDFs of the isolation forest.
#  - checkpoint cleanup: files of checkpoints, if a caller makes any, are removed when no
#    longer used.  The library's own intermediates are spooled (``plans.spool``).
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpoint files are deleted once the DataFrames reading them are gone
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(
    master: str | None = None,
    shuffle_partitions: int | None = None,
    app_name: str = "ledgerlark",
    extra: dict | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the settings above."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    # getOrCreate() may hand back an existing session: re-apply the SQL settings.
    for k, v in conf.items():
        if k.startswith("spark.sql."):
            spark.conf.set(k, v)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory, setting a scratch one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as is.
    Only a local master gets a fresh folder under the system temp dir when nothing is
    configured; executors on other machines could not read one, so that raises.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not configured and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not configured:
        configured = tempfile.mkdtemp(prefix="ledgerlark-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


#: Bytes of the largest Parquet input for each shuffle partition (some 300 000 narrow rows),
#: and partitions at most.
INPUT_BYTES_OF_PARTITION = 4 << 20
MOST_PARTITIONS = 40_000
_INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"

#: What goes with many small shuffle partitions: they are merged to 16 MB, joined by hashing
#: where all of them are that small, not dealt again for a join on more columns; scans whose
#: rows are grouped at once are split as finely.
SMALL_TASKS = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(16 << 20),
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": str(16 << 20),
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.files.maxPartitionBytes": str(32 << 20),
}


def size_shuffles(spark: SparkSession, n_bytes: int) -> None:
    """Let the number of shuffle partitions grow with an input of ``n_bytes``.

    A task sorts and groups a bounded number of rows then, instead of a fixed share of all.
    Never fewer partitions than ``spark.sql.shuffle.partitions``; adaptive execution merges
    the small ones.  Settings that the application was started with stay as they are.
    """
    given = spark.sparkContext.getConf()
    for key, value in SMALL_TASKS.items():
        if not given.contains(key):
            spark.conf.set(key, value)
    if given.contains(_INITIAL):
        return
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = min(MOST_PARTITIONS, -(-n_bytes // INPUT_BYTES_OF_PARTITION))
    if wanted > least:
        spark.conf.set(_INITIAL, str(wanted))
    else:
        spark.conf.unset(_INITIAL)


_PACKAGE_ZIP: str | None = None
_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``ledgerlark`` importable in Python workers (once per SparkContext).

    pandas UDFs and ``mapInPandas`` functions refer to this package by module name, so
    executors need it on their path; it is zipped once and added with
    ``SparkContext.addPyFile`` (the programmatic form of ``--py-files``).
    """
    global _PACKAGE_ZIP
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    if _PACKAGE_ZIP is None:
        pkg_dir = os.path.dirname(os.path.abspath(__file__))
        root = os.path.dirname(pkg_dir)
        out = os.path.join(tempfile.mkdtemp(prefix="ledgerlark-pkg-"), "ledgerlark.zip")
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as zf:
            for dirpath, _, files in os.walk(pkg_dir):
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(dirpath, f)
                        zf.write(full, os.path.relpath(full, root))
        _PACKAGE_ZIP = out
    sc.addPyFile(_PACKAGE_ZIP)
    _SHIPPED.add(key)
