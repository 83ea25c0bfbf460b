"""Append-only parquet tables of the ledger, rooted in one folder.

Plain parquet has no UPDATE/MERGE/DELETE, so state is kept as facts and
events (see ``operators.status``):

* ``detail``         ledger rows, partitioned by month (``ym`` = yyyyMM of
                     ``date``) so the dedup probe reads only the months of an
                     incoming drop;
* ``detail_status``  check / forward / reset events keyed by detail id;
* ``extract_rule``   small versioned snapshots ``v=<n>/``;
* ``import_history``, ``asset_history``, ``outbox``, ``classify_run``
                     append-only.

Rows are written in runs. A run writes each table into a folder of its own
(``<table>/run=<id>~<part>/``) and becomes visible, all tables at once, when
its marker appears: ``_commits/<number>~<id>``, one rename. ``read`` lists the
folders of committed runs only, so what a dead run left is never seen, and a
retry under the same id overwrites it. A marker holds, for each table, the
rows and the largest id of the store so far: counts and maxima need no scan.
``detail_keys`` holds the key index of each run's ledger rows, and
``status_base`` the current status as of an earlier commit.
Rule snapshots are read only once their ``_SUCCESS`` exists. One writer at a
time; a second one fails at its marker's number and nothing of it is seen.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import key_index
from ..operators.dedup import LEDGER_KEY
from ..operators.ordinal import parts_for
from ..session import DIRECT_COMMIT

TABLES = {
    "detail": (schemas.DETAIL, ["ym"]),
    "detail_status": (schemas.DETAIL_STATUS, []),
    "import_history": (schemas.IMPORT_HISTORY, []),
    "asset_history": (schemas.ASSET_HISTORY, []),
    "outbox": (schemas.OUTBOX, []),
    "classify_run": (schemas.CLASSIFY_RUN, []),
}


def month_key(date_col):
    """yyyyMM as an int: the partition value of a date."""
    return (F.year(date_col) * 100 + F.month(date_col)).cast("int")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def qualify(spark: SparkSession, path: str) -> str:
    """Fully qualified form of ``path`` (scheme included), as listings give it."""
    fs, p = _fs(spark, path)
    return str(fs.makeQualified(p).toString()).rstrip("/")


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def list_dirs(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    return [st.getPath().getName() for st in fs.listStatus(p) if st.isDirectory()]


#: Tables with a key index, and their keys.
INDEXED = {"detail": LEDGER_KEY}
#: The column whose largest value a commit marker records.
TOP_COLUMN = {"detail_status": "seq", "outbox": "seq", "classify_run": "seq"}


#: Page marks of a run with holes; a marker holds at most four times as many.
MARKS = 500


class WriteConflict(RuntimeError):
    """Another run committed in between; nothing of this run is visible."""


class Run:
    """One run's writes to a store, invisible until ``commit``."""

    def __init__(self, store: LedgerStore, run_id: str, part: str = ""):
        if not run_id or any(c in run_id for c in "~/="):
            raise ValueError(f"bad run id {run_id!r}")
        self.store, self.run_id, self.part = store, run_id, part
        self.number, self.stats = store._last_commit()

    def under(self, part: str) -> Run:
        """The same run writing to folders of another part."""
        other = Run.__new__(Run)
        other.store, other.run_id, other.part = self.store, self.run_id, part
        other.number, other.stats = self.number, self.stats
        return other

    def top(self, name: str) -> int:
        """Largest id (or batch number) of a table, this run's rows included."""
        return self.stats.get(name, {}).get("top") or 0

    def append(self, name: str, df: DataFrame, rows: int | None = None) -> None:
        """``rows``: their number, if known."""
        schema, parts = TABLES[name]
        if "ym" in parts and "ym" not in df.columns:
            df = df.withColumn("ym", month_key(F.col("date")))
        if name == "detail_status" and "written_at" not in df.columns:
            df = df.withColumn("written_at", F.current_timestamp())
        out = df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
        if parts:
            # each task gets a contiguous (partition, id) slice: few files per
            # month, and a hot month is still cut across several tasks
            n = [] if rows is None else [parts_for(self.store.spark, rows)]
            out = out.repartitionByRange(*n, *[F.col(p) for p in parts], F.col("id"))
        facts = Observation()
        number = TOP_COLUMN.get(name, "id")
        out = out.observe(facts, F.count(F.lit(1)).alias("rows"), F.min(number).alias("least"), F.max(number).alias("top"))
        w = out.write.mode("overwrite").options(**DIRECT_COMMIT)  # what a dead run of this id left goes
        if parts:
            w = w.partitionBy(*parts)
        w.parquet(f"{self.store.path(name)}/run={self.run_id}~{self.part}")
        found, known = facts.get, self.stats.get(name, {})
        self.stats[name] = {"rows": known.get("rows", 0) + found["rows"], "months": known.get("months", {}),
                            "top": max((t for t in (known.get("top"), found["top"]) if t is not None), default=None)}
        if name in INDEXED and found["rows"]:
            self._append_index(name)
            self.stats[name]["marks"] = self._marks(name, known.get("marks", []), found)

    def _marks(self, name: str, marks: list | None, found: dict) -> list | None:
        """Page marks: [id, rows up to it] in ascending order, for every run
        and, where a run's ids have holes, for up to MARKS ranges of it. None
        once a run's ids do not all lie above those before it."""
        before = marks[-1] if marks else [None, 0]
        if marks is None or (before[0] is not None and found["least"] <= before[0]):
            return None
        if found["top"] - found["least"] + 1 == found["rows"]:
            if before[0] is None or found["least"] > before[0] + 1:  # a gap between runs is a range without rows
                marks = [*marks, [found["least"] - 1, before[1]]]
            marks = [*marks, [found["top"], before[1] + found["rows"]]]
        else:
            width = max((found["top"] - found["least"] + MARKS) // MARKS, 1)
            own = self.store._files(name, [f"run={self.run_id}~{self.part}"])
            part = F.floor((F.col("id") - found["least"]) / width)
            n, marks = before[1], [*marks, [found["least"] - 1, before[1]]]
            for _, rows, top in sorted(own.groupBy(part).agg(F.count(F.lit(1)), F.max("id")).collect()):  # MARKS rows at most
                n += rows
                marks.append([top, n])
        while len(marks) > 4 * MARKS:  # every second one, and the last
            marks = [m for i, m in enumerate(marks) if i % 2 or i == len(marks) - 1]
        return marks

    def _append_index(self, name: str) -> None:
        """Index the keys just written (see ``operators.key_index``). Months
        and their row counts so far are part of the marker."""
        folder = f"run={self.run_id}~{self.part}"
        own = self.store._files(name, [folder]).select(*INDEXED[name], "ym")
        months = dict(self.stats[name]["months"])
        grown = {r[0]: r[1] for r in own.groupBy("ym").count().collect()}  # a row for each month
        for ym, n in grown.items():
            months[str(ym)] = months.get(str(ym), 0) + n
        self.stats[name]["months"] = months
        levels = {ym: key_index.level(months[str(ym)]) for ym in grown}
        index = key_index.index_rows(own, INDEXED[name], levels)
        index.write.mode("overwrite").options(**DIRECT_COMMIT).parquet(f"{self.store.path(name)}_keys/{folder}")

    def commit(self) -> None:
        """Make all writes of the run visible at once."""
        folder = f"{self.store.root}/_commits"
        fs, tmp = _fs(self.store.spark, f"{folder}/.{uuid.uuid4().hex}")
        out = fs.create(tmp)
        out.write(bytearray(json.dumps(self.stats).encode()))
        out.close()
        _, marker = _fs(self.store.spark, f"{folder}/{self.number + 1:020d}~{self.run_id}")
        if self.store._last_commit()[0] != self.number or not fs.rename(tmp, marker):
            fs.delete(tmp, False)
            raise WriteConflict(f"run {self.run_id} is not the next after commit {self.number}")


class LedgerStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    # -- runs --------------------------------------------------------------
    def _markers(self) -> list[str]:
        fs, p = _fs(self.spark, f"{self.root}/_commits")
        names = [st.getPath().getName() for st in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(n for n in names if not n.startswith((".", "_")))

    def _last_commit(self) -> tuple[int, dict]:
        """Number of the newest commit and the store's facts at it."""
        markers = self._markers()
        if not markers:
            return 0, {}
        fs, p = _fs(self.spark, f"{self.root}/_commits/{markers[-1]}")
        size = fs.getFileStatus(p).getLen()
        source = fs.open(p)
        data = bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(source, size))
        source.close()
        return int(markers[-1].split("~")[0]), json.loads(data)

    def _commits(self) -> dict[str, int]:
        """Run id -> number of its commit."""
        return {m.split("~", 1)[1]: int(m.split("~", 1)[0]) for m in self._markers()}

    def committed(self, run_id: str) -> bool:
        return run_id in self._commits()

    def begin(self, run_id: str | None = None) -> Run:
        """A run to write in; the id is a fresh one unless the caller retries."""
        if run_id is not None and self.committed(run_id):
            raise ValueError(f"run {run_id} is committed")
        return Run(self, run_id or uuid.uuid4().hex)

    def folders(self, name: str, run_id: str | None = None, after: int = 0) -> list[str]:
        """Committed run folders of a table: of one run, or of the commits
        after a number, if given."""
        done = self._commits()
        own = {d: d[4:].split("~")[0] for d in list_dirs(self.spark, self.path(name)) if d.startswith("run=")}
        return sorted(d for d, r in own.items() if done.get(r, 0) > after and run_id in (None, r))

    def abandoned(self) -> list[str]:
        """Ids of runs that wrote rows but never committed."""
        left = {d[4:].split("~")[0] for name in TABLES for d in list_dirs(self.spark, self.path(name))
                if d.startswith("run=")}
        return sorted(left - set(self._commits()))

    def _files(self, name: str, folders: list[str]) -> DataFrame:
        schema, _ = TABLES[name]
        if not folders:
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.schema(schema).option("basePath", self.path(name)) \
            .parquet(*[f"{self.path(name)}/{d}" for d in folders])
        return df.select(*schema.fieldNames())

    def read(self, name: str) -> DataFrame:
        return self._files(name, self.folders(name))

    def read_run(self, name: str, run_id: str) -> DataFrame:
        """The rows that one committed run wrote."""
        return self._files(name, self.folders(name, run_id))

    def key_index(self, name: str) -> DataFrame:
        """Key index of the committed rows of a table."""
        folders = self.folders(name)
        if not folders:
            return self.spark.createDataFrame([], key_index.KEY_INDEX)
        return self.spark.read.schema(key_index.KEY_INDEX).parquet(*[f"{self.path(name)}_keys/{d}" for d in folders])

    def top(self, name: str) -> int:
        """Largest id (batch number) of a table, from the newest marker."""
        return self._last_commit()[1].get(name, {}).get("top") or 0

    def rows(self, name: str) -> int:
        """Rows of a table (A1), from the newest marker."""
        return self._last_commit()[1].get(name, {}).get("rows", 0)

    def marks(self, name: str) -> list | None:
        """Page marks of a table (see ``views.stored_page``)."""
        return self._last_commit()[1].get(name, {}).get("marks", [])

    # -- status base + tail --------------------------------------------------
    def status_parts(self) -> tuple[DataFrame, DataFrame, int]:
        """The status base (one latest event per id, in files cut by id range),
        the events committed after it, and their number. Older events are
        neither listed nor read."""
        stats = self._last_commit()[1]
        base = stats.get("status_base")
        tail = self._files("detail_status", self.folders("detail_status", after=base["commit"] if base else 0))
        n_tail = self.rows("detail_status") - (base["events"] if base else 0)
        if base is None:
            return self.spark.createDataFrame([], schemas.DETAIL_STATUS), tail, n_tail
        return self.spark.read.schema(schemas.DETAIL_STATUS).parquet(f"{self.root}/status_base/{base['folder']}"), tail, n_tail

    def status(self) -> DataFrame:
        """The latest event of each id, from base and tail."""
        from ..operators.status import merged_state
        return merged_state(*self.status_parts())

    def compact_status(self, least_tail: int = 0) -> bool:
        """Write the next status base, if the tail has ``least_tail`` events and
        as many as the base has rows (so an event is rewritten a logarithmic
        number of times). One commit swaps it in."""
        stats = self._last_commit()[1]
        base, n_tail = stats.get("status_base", {}), self.status_parts()[2]
        if not n_tail or (least_tail and n_tail < max(least_tail, base.get("rows", 0))):
            return False
        run, facts = self.begin(), Observation()
        state = self.status().select(*schemas.DETAIL_STATUS.fieldNames())
        (state.repartitionByRange("detail_id").sortWithinPartitions("detail_id")
         .observe(facts, F.count(F.lit(1)).alias("rows"))
         .write.options(**DIRECT_COMMIT).parquet(f"{self.root}/status_base/{run.run_id}"))
        run.stats["status_base"] = {"folder": run.run_id, "commit": run.number + 1, "rows": facts.get["rows"],
                                    "events": stats["detail_status"]["rows"]}
        run.commit()
        return True

    def append(self, name: str, df: DataFrame) -> None:
        """A run of one write."""
        run = self.begin()
        run.append(name, df)
        run.commit()

    # -- rule snapshots ---------------------------------------------------
    def rule_versions(self) -> list[int]:
        vs = []
        for d in list_dirs(self.spark, self.path("extract_rule")):
            if d.startswith("v="):
                v = int(d[2:])
                if path_exists(self.spark, f"{self.path('extract_rule')}/{d}/_SUCCESS"):
                    vs.append(v)
        return sorted(vs)

    def rules(self) -> DataFrame:
        vs = self.rule_versions()
        if not vs:
            return self.spark.createDataFrame([], schemas.EXTRACT_RULE)
        return self.spark.read.schema(schemas.EXTRACT_RULE).parquet(
            f"{self.path('extract_rule')}/v={vs[-1]}")

    def write_rules(self, df: DataFrame) -> int:
        """Write a new snapshot; the previous one stays readable until this
        one has committed."""
        vs = self.rule_versions()
        v = (vs[-1] + 1) if vs else 1
        out = df.select(*[F.col(f.name).cast(f.dataType) for f in schemas.EXTRACT_RULE.fields])
        out.write.mode("overwrite").parquet(f"{self.path('extract_rule')}/v={v}")
        return v

    def register_views(self, prefix: str = "") -> list[str]:
        """Temp views for ``spark.sql``: every table, the latest rule snapshot
        as ``extract_rule``, and ``detail_current`` (rows with their two status
        dates, the shape of the original ledger table)."""
        from ..operators.status import with_state
        names = []
        for name in TABLES:
            self.read(name).createOrReplaceTempView(prefix + name)
            names.append(prefix + name)
        self.rules().createOrReplaceTempView(prefix + "extract_rule")
        with_state(self.read("detail"), self.status()) \
            .createOrReplaceTempView(prefix + "detail_current")
        return names + [prefix + "extract_rule", prefix + "detail_current"]

    def exists(self, name: str) -> bool:
        return os.path.basename(name) in TABLES and bool(self.folders(name))
