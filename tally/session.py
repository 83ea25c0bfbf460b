"""Session settings the engine relies on, and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import SparkSession
from pyspark.util import inheritable_thread_target

# Settings that change results, not only speed:
#  - javaCharsets: Spark 4 refuses Shift_JIS for CSV unless the legacy charset
#    table is enabled, and stops at malformed text instead of replacing it.
#  - session time zone: ledger dates are calendar days in the exporter's zone.
ENGINE_CONF = {
    "spark.sql.legacy.javaCharsets": "true",
    "spark.sql.legacy.codingErrorAction": "true",
    "spark.sql.session.timeZone": "Asia/Tokyo",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "tally", extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench. On a cluster, pass the same
    ``ENGINE_CONF`` through spark-submit instead."""
    b = (SparkSession.builder.master(master).appName(app_name)
         .config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", "8g"))
    for k, v in {**ENGINE_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    apply_engine_conf(spark)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_engine_conf(spark: SparkSession, time_zone: bool = True) -> None:
    """Set the runtime SQL settings on an existing session (idempotent).
    ``time_zone=False`` leaves the caller's session zone alone (only
    ``current_date()`` defaults depend on it)."""
    for k, v in ENGINE_CONF.items():
        if not time_zone and k == "spark.sql.session.timeZone":
            continue
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for ``checkpoint()`` and staging tables.

    The cluster names it in ``spark.checkpoint.dir``; only when that is unset
    (local tests) a private temporary folder is created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        conf = tempfile.mkdtemp(prefix="tally-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for a written table."""
    base = checkpoint_dir(spark)
    import uuid
    return os.path.join(base, "staging", f"{name}-{uuid.uuid4().hex}")


# Task output goes straight to its place: such a folder is read only after the
# whole write has ended, so nobody can see part of it.
DIRECT_COMMIT = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}


def stage(df, name: str = "stage"):
    """Write ``df`` once as parquet under the shared checkpoint folder and
    read it back: lineage is cut, a lost executor re-reads the files instead
    of recomputing, and later reads prune columns."""
    spark = df.sparkSession
    path = staging_path(spark, name)
    df.write.options(**DIRECT_COMMIT).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_thread(spark: SparkSession, pool: ThreadPoolExecutor, call) -> Future:
    """``call`` in a thread of the pool that has this thread's job settings."""
    return pool.submit(inheritable_thread_target(spark)(call))


def side_by_side(spark: SparkSession, *calls) -> list:
    """Results of calls that do not need each other, each in a thread of its
    own: the many small jobs of a run overlap. All have ended before the first
    error is raised."""
    with ThreadPoolExecutor(len(calls)) as pool:
        ended = [in_thread(spark, pool, c) for c in calls]
    return [e.result() for e in ended]


_T0 = [0.0]


def lap(msg: str | None) -> None:
    """Step timing on stderr when TALLY_PROFILE is set; ``None`` restarts."""
    if not os.environ.get("TALLY_PROFILE"):
        return
    import sys
    import time
    now = time.time()
    if msg is not None and _T0[0]:
        print(f"[tally] {msg}: {now - _T0[0]:.2f}s", file=sys.stderr, flush=True)
    _T0[0] = now
