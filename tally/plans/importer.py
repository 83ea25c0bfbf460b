"""Import a drop of ledger and asset CSVs into the store.

One DataFrame job per table for all files of the run (the source probes the
database once per row). Flow for the ledger:

    scan (S3) -> positions + types (F1-F3, C1, C2, W1), written once
    -> policy (M9) -> first processed per key (A6)
    -> |> stored keys of the same months (J1) -> ids (K5, staged) -> append (K1)
    -> per-file counts (A2, A3) -> conditional history (M5) -> append (K2)
    -> commit

A run is visible as a whole or not at all: detail, asset rows and history
appear with its commit (``sources.store``). A run that dies leaves nothing to
see; its retry, under the same ``run_id`` or a new one, starts from the state
before it. A committed ``run_id`` is not run again.

Typed rows and ordered new rows are written to the shared checkpoint folder,
nothing is cached: a lost executor re-reads them, and the returned frames read
them instead of parsing the drop again.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import dedup, key_index, validate
from ..operators.ordinal import global_ordinal, parts_for, small_ordinal
from ..session import in_thread, lap, side_by_side, stage
from ..sources.csv_scan import read_text, run_files, scan_asset_csv, scan_ledger_csv
from ..sources.store import LedgerStore, Run, month_key


class ImportAborted(RuntimeError):
    """A file had a bad row; files ranked before it were imported."""


@dataclass
class ImportResult:
    inserted: DataFrame        # rows appended (or, dry run, that would be)
    duplicates: DataFrame | None  # rows skipped as already stored (J3)
    counts: DataFrame | None   # per file parsed / new counts (A2, A3)
    history: DataFrame         # history rows written (M5 / M6)
    report: DataFrame | None   # per file validity (M9)
    rejects: DataFrame | None  # the bad records themselves
    replayed: bool = False     # the run was committed before: only its stored rows are given


@dataclass(frozen=True)
class Kind:
    """What sets ledger and asset imports apart."""
    name: str
    table: str
    key: list[str]
    reverse_rows: bool
    months: bool


LEDGER = Kind("ledger", "detail", dedup.LEDGER_KEY, True, True)
ASSET = Kind("asset", "asset_history", dedup.ASSET_KEY, False, False)
KINDS = {"ledger": LEDGER, "asset": ASSET}


def _typed_facts(columns: list[str]) -> list[Column]:
    """Over a run's typed rows: the abort cut (first file with a bad row) and,
    over the good data rows, the date range, row count and bytes of names.
    The range may include files after the cut, which only widens the probe."""
    good = ~F.col("is_header") & F.col("reject").isNull()
    text = F.octet_length("name") if "name" in columns else F.lit(0)
    return [F.min(F.when(F.col("reject").isNotNull(), F.col("file_rank"))).alias("cut"),
            F.min(F.when(good, F.col("date"))).alias("lo"),
            F.max(F.when(good, F.col("date"))).alias("hi"),
            F.count(F.when(good, 1)).alias("n"),
            F.coalesce(F.sum(F.when(good, text)), F.lit(0)).alias("bytes")]


def _run_facts(r: dict, policy: str):
    cut = r["cut"] if policy == "abort" else None
    # a row count is a bound for a broadcast only while its text is small too
    n = r["n"] if r["bytes"] <= dedup.MAX_BROADCAST_BYTES else None
    return cut, (r["lo"], r["hi"], n)


def _imported_files(files: DataFrame, typed: DataFrame, cut: int | None, policy: str) -> DataFrame:
    """The files of the run that were imported (M9), with or without rows."""
    if policy == "abort":
        return files if cut is None else files.filter(F.col("file_rank") < cut)
    bad = typed.filter(F.col("reject").isNotNull()).select("src_path").distinct()
    return files.join(bad, "src_path", "left_anti")


def _date_window(existing: DataFrame, bounds, partitioned: bool = False) -> DataFrame:
    """Restrict stored keys to the date range of the incoming rows. For the
    month-partitioned ``detail`` the same bounds on ``ym`` prune whole
    folders at planning time."""
    lo, hi = bounds[0], bounds[1]
    if lo is None:
        return existing.limit(0)
    cond = F.col("date").between(F.lit(lo), F.lit(hi))
    return (_month_window(existing, bounds) if partitioned else existing).filter(cond)


def _month_window(df: DataFrame, bounds) -> DataFrame:
    """Rows of the months (``ym``) of the incoming date range."""
    lo, hi = bounds[0], bounds[1]
    if lo is None:
        return df.limit(0)
    return df.filter(F.col("ym").between(lo.year * 100 + lo.month, hi.year * 100 + hi.month))


def _numbered(run: Run, kind: Kind, new: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """K5: ids after the stored maximum. The new rows are written once: the
    count is taken from the write, and the range sampling and the ordering
    shuffle read the copy. Gives the rows with ids, without, and their number."""
    facts = Observation()
    new = stage(new.observe(facts, F.count(F.lit(1)).alias("n")), "new")
    lap("new rows staged")
    n = facts.get["n"]
    if not n:
        return new.withColumn("id", F.lit(None).cast("long")), new, n
    numbered = dedup.assign_ids(new, run.top(kind.table), reverse_rows=kind.reverse_rows,
                                num_partitions=parts_for(new.sparkSession, n))
    lap("ids staged")
    return numbered, new, n


def _append_rows(run: Run, kind: Kind, numbered: DataFrame, n: int) -> None:
    """K1. An all-duplicate re-run (the steady state of overlapping exports)
    writes nothing."""
    if n:
        run.append(kind.table, numbered.withColumn("created_at", F.current_timestamp())
                   .withColumn("updated_at", F.current_timestamp()), rows=n)
        lap(f"{kind.table} appended")


def _history_rows(base: int, delta: DataFrame, job_label: str | None, n_files: int) -> DataFrame:
    """At most one row per file of the run (the listing bounds them), numbered
    in rank order."""
    ordered = small_ordinal(delta, [F.col("file_rank")], "_o", n_files)
    return (ordered
            .select((F.lit(base) + F.col("_o") + 1).cast("long").alias("id"),
                    F.lit(job_label).cast("string").alias("job_label"),
                    F.col("parsed_entry_num").cast("long"), F.col("new_entry_num").cast("long"),
                    F.col("src_file"),
                    F.current_timestamp().alias("created_at"),
                    F.current_timestamp().alias("updated_at")))


def _typed_rows(spark: SparkSession, kind: Kind, paths, files: DataFrame, *, run_date=None, encoding: str = "utf8",
                multiline: bool = True, split_bytes: int | None = None) -> tuple[DataFrame, dict]:
    """Scanned and typed rows of a drop, written once, and their facts."""
    if kind is LEDGER:
        rows = validate.type_ledger(scan_ledger_csv(spark, paths, encoding, multiline, files, split_bytes), run_date)
    else:
        rows = validate.type_asset(scan_asset_csv(spark, paths, encoding, multiline, files, split_bytes))
    lap(f"{kind.name} lines staged")
    facts = Observation()
    out = stage(rows.observe(facts, *_typed_facts(rows.columns)), "typed")
    lap(f"{kind.name} typed")
    return out, facts.get


def _by_index(index: DataFrame, kind: Kind, rows: DataFrame, known: DataFrame, dry_run: bool,
              bound: int, bounds, unique_positions: bool) -> tuple[DataFrame, DataFrame]:
    """J1 / J3 for a drop with more keys than are broadcast: the key index
    tells which may be stored, and only these are looked up exactly, in their
    months. Stored rows that cannot match are dropped in the scan; none is
    read where no key may be stored."""
    key = kind.key
    keys = rows.select(*key, month_key(F.col("date")).alias("ym"))
    maybe = stage(key_index.possible_hits(keys, _month_window(index, bounds), key), "maybe")
    facts = maybe.groupBy("ym").agg(F.count(F.lit(1)), F.sum(F.octet_length("name"))).collect()  # a row for each month
    n, size = sum(r[1] for r in facts), sum(r[2] for r in facts)
    lap("index probed")
    if not n:
        hits = maybe.select(*key)
    else:
        own = known.filter(F.col("ym").isin([r[0] for r in facts])).select(*key)
        if n <= bound and size <= dedup.MAX_BROADCAST_BYTES:
            hits = dedup.stored_hits(maybe, own, key, n)
        else:
            hits = key_index.sifted(own, maybe, n, key).join(maybe.select(*key), key, "left_semi").distinct()
        hits = stage(hits, "hits")
        lap("stored keys looked up")
    hits = F.broadcast(hits) if n <= bound and size <= dedup.MAX_BROADCAST_BYTES else hits
    new = rows if dry_run else dedup.first_processed(rows, key, kind.reverse_rows, unique_positions)
    return new.join(hits, key, "left_anti"), rows.join(hits, key, "left_semi")


# The name's spelling that stands for all that are equal under a collation.
SPELLING = "_spelling"


def _collated(rows: DataFrame, stored: DataFrame, key: list[str], collation: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Incoming and stored rows with the key in one spelling. Names are
    compared under the collation once for each distinct name; rows are then
    joined and grouped by plain text. A null name stays null."""
    names = rows.select("name").unionByName(stored.select("name")).distinct()
    alike = F.collate(F.col("name"), collation)
    first = names.groupBy(alike.alias("_alike")).agg(F.min("name").alias(SPELLING))
    spelled = stage(names.join(first, alike == F.col("_alike")).select("name", SPELLING), "spellings")
    lap("names spelled alike")
    own = [SPELLING if k == "name" else k for k in key]
    rows = dedup.keyed(rows.join(spelled, "name", "left").select(*rows.columns, SPELLING), key, collation)
    return rows, stored.join(spelled, "name", "left").select(*own), own


def _listed(store: LedgerStore, kinds: list[Kind]) -> dict:
    """Calls that list the committed folders which an import of ``kinds``
    reads: there are more with every run, and no list needs another."""
    calls = {t: partial(store.read, t) for t in [*[k.table for k in kinds], "import_history"]}
    return calls | {f"{k.table}_keys": partial(store.key_index, k.table) for k in kinds if k.months}


def _import_typed(held: dict[str, DataFrame], run: Run, kind: Kind, typed: DataFrame, files: DataFrame, n_files: int,
                  cut: int | None, bounds, *, job_label: str | None = None, dry_run: bool = False, policy: str = "abort",
                  collation: str | None = None, index_above: int = dedup.MAX_BROADCAST_KEYS) -> ImportResult:
    """The import of one kind's typed rows into ``run``, not yet committed.
    ``held``: the store's frames (see ``_listed``)."""
    rows, report = validate.accepted(typed, policy, cut)
    unique = n_files <= dedup.MAX_RANK  # a record's rank and place are its own
    key, n_rows = kind.key, bounds[2]  # the count bounds the broadcast of incoming keys
    # only committed runs are read, so the rows of this one are not part of the stored side
    known = held[kind.table].select(*key, *(["ym"] if kind.months else []))
    stored = _date_window(known, bounds, partitioned=kind.months).select(*key)
    collated = bool(collation) and kind is LEDGER  # the asset key holds no text
    if collated:
        rows, stored, key = _collated(rows, stored, key, collation)
    if kind.months and not collation and (n_rows is None or n_rows > index_above):
        inserted, duplicates = _by_index(held[f"{kind.table}_keys"], kind, rows, known, dry_run, index_above, bounds, unique)
    else:
        inserted = dedup.import_plan(rows, stored, key, reverse_rows=kind.reverse_rows, dry_run=dry_run, incoming_rows=n_rows,
                                     unique_positions=unique)
        duplicates = dedup.duplicate_rows(rows, stored, key, incoming_rows=n_rows)
    plain = inserted
    if not dry_run:
        inserted, plain, n_new = _numbered(run, kind, inserted)
    if collated:
        inserted, duplicates = inserted.drop(SPELLING), duplicates.drop(SPELLING)

    def record() -> tuple[DataFrame, DataFrame]:
        counts = stage(dedup.file_facts(_imported_files(files, typed, cut, policy), rows, plain), "counts")
        delta = dedup.ledger_history_delta(counts, held["import_history"]) if kind is LEDGER \
            else dedup.asset_history_delta(counts)
        lap("counts staged")
        history = stage(_history_rows(run.top("import_history"), delta, job_label, n_files), "history")
        if not dry_run:
            run.append("import_history", history)
        lap("history appended")
        return counts, history

    if dry_run:
        counts, history = record()
    else:  # the counts need the new rows, not the append
        (counts, history), _ = side_by_side(run.store.spark, record, lambda: _append_rows(run, kind, inserted, n_new))
    return ImportResult(inserted, duplicates, counts, history, report, validate.rejects(typed))


def _replayed(store: LedgerStore, run_id: str, table: str) -> ImportResult:
    return ImportResult(store.read_run(table, run_id), None, None, store.read_run("import_history", run_id), None, None, True)


@dataclass
class Scan:
    """The typed rows of a run's files, written; nothing of the store is read."""
    listed: dict[str, list[str]]  # URIs by kind
    files: DataFrame
    typed: dict[str, DataFrame]
    facts: dict[str, tuple]


def _scan_kinds(spark: SparkSession, by_kind: dict[str, list[str]], *, run_date=None, policy: str = "abort",
                encoding: str = "utf8", multiline: bool = True, split_bytes: int | None = None) -> Scan:
    kinds = [KINDS[k] for k in ("ledger", "asset") if by_kind.get(k)]
    texts = {k.name: read_text(spark, by_kind[k.name]) for k in kinds}
    listed = {k: text.inputFiles() for k, text in texts.items()}
    # one rank over the files of both kinds, so that one cut means the same for both
    files = run_files(spark, [u for uris in listed.values() for u in uris])
    lap("files listed")
    scans = [partial(_typed_rows, spark, k, texts[k.name], files, run_date=run_date, encoding=encoding, multiline=multiline,
                     split_bytes=split_bytes) for k in kinds]
    # a split size of the caller's is the session's while the text is read
    found = side_by_side(spark, *scans) if len(scans) > 1 and split_bytes is None else [scan() for scan in scans]
    return Scan(listed, files, {k.name: f[0] for k, f in zip(kinds, found)},
                {k.name: _run_facts(f[1], policy) for k, f in zip(kinds, found)})


def _import_kinds(spark: SparkSession, store: LedgerStore, by_kind: dict[str, list[str]], *, run_id: str | None = None,
                  job_label: str | None = None, run_date=None, dry_run: bool = False, policy: str = "abort",
                  encoding: str = "utf8", collation: str | None = None, multiline: bool = True,
                  index_above: int = dedup.MAX_BROADCAST_KEYS, split_bytes: int | None = None,
                  scan: Scan | None = None) -> dict[str, ImportResult]:
    """Import files of one or both kinds as one run with one commit. Under
    ``abort`` the files are one sequence in name order, whatever their kind:
    the first file with a bad row (ledger or asset) stops the run, and only
    files named before it are imported. ``scan``: of these files, if made before."""
    kinds = [KINDS[k] for k in ("ledger", "asset") if by_kind.get(k)]
    if run_id is not None and store.committed(run_id):
        return {k.name: _replayed(store, run_id, k.table) for k in kinds}
    lap(None)
    lists = _listed(store, kinds) if kinds else {}
    scanning = partial(_scan_kinds, spark, by_kind, run_date=run_date, policy=policy, encoding=encoding, multiline=multiline,
                       split_bytes=split_bytes) if scan is None else lambda: scan
    scan, *found = side_by_side(spark, scanning, *lists.values())
    held = dict(zip(lists, found))
    files, typed, facts = scan.files, scan.typed, scan.facts
    cut = min((f[0] for f in facts.values() if f[0] is not None), default=None)
    # a run cut short is not the run that was asked for: its retry must do the rest
    run, out = store.begin(run_id if cut is None else None), {}
    for k in kinds:
        own = files
        if len(kinds) > 1:
            own = files.join(run_files(spark, scan.listed[k.name]).select("src_path"), "src_path", "left_semi")
        out[k.name] = _import_typed(held, run.under(k.name), k, typed[k.name], own, len(scan.listed[k.name]), cut,
                                    facts[k.name][1], job_label=job_label, dry_run=dry_run, policy=policy, collation=collation,
                                    index_above=index_above)
    if not dry_run and kinds:
        run.commit()
        lap("committed")
    if cut is not None:
        name = files.filter(F.col("file_rank") == cut).first()["src_file"]
        raise ImportAborted(f"file {name} has invalid rows; it and later files were not imported")
    return out


def _paths(paths) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def import_ledger(spark: SparkSession, store: LedgerStore, paths, **kw) -> ImportResult:
    """M11. Options: ``job_label``, ``run_date``, ``dry_run``, ``policy``
    (``abort`` | ``quarantine``), ``encoding``, ``collation``, ``multiline``,
    ``index_above`` (rows beyond which the key index is probed),
    ``split_bytes`` (size of the splits the files are read in) and ``run_id`` (a retry under the id of a dead run replaces what it left;
    a committed run is not run again)."""
    return _import_kinds(spark, store, {"ledger": _paths(paths)}, **kw)["ledger"]


def import_assets(spark: SparkSession, store: LedgerStore, paths, **kw) -> ImportResult:
    """Same flow keyed by date; first row of a file wins (no reversal);
    history only when a row was inserted (M6). ``run_date`` and ``collation``
    are accepted for a uniform call and unused (no text key)."""
    return _import_kinds(spark, store, {"asset": _paths(paths)}, **kw)["asset"]


# Files of one run at most: bounds the paths, per-file tables and ranks that the
# driver holds for it.
MAX_RUN_FILES = 10_000
# Options of a run that its scan takes.
SCAN_OPTIONS = ("run_date", "policy", "encoding", "multiline", "split_bytes")


def _import_manifest(spark: SparkSession, store: LedgerStore, routed: DataFrame, name_col: str, *,
                     max_files: int = MAX_RUN_FILES, run_id: str | None = None, **kw) -> dict[str, ImportResult]:
    """Import a routed manifest (path, kind, name) in runs of at most
    ``max_files`` files in name order, each with its own commit. With a
    ``run_id``, a later call under it goes on behind the runs that are
    committed. A drop of one run gives that run's results; of several, the
    last run's. The files of the next run are scanned while a run is imported:
    a scan reads nothing of the store."""
    manifest = global_ordinal(routed.select("path", "kind", F.col(name_col).alias("_name")),
                              [F.col("_name"), F.col("path")], "_rank")
    facts = Observation()
    manifest = stage(manifest.observe(facts, F.count(F.lit(1)).alias("n")), "manifest")  # written once, read by each run
    n = facts.get["n"]
    ids = [run_id] if n <= max_files else [run_id and f"{run_id}.{k}" for k in range(-(-n // max_files))]
    left = [k for k, own_id in enumerate(ids) if len(ids) == 1 or own_id is None or not store.committed(own_id)]

    def files_of(k: int) -> dict[str, list[str]]:
        own = manifest.filter(F.col("_rank").between(k * max_files, (k + 1) * max_files - 1)).select("path", "kind").collect()
        return {kind: [r.path for r in own if r.kind == kind] for kind in KINDS}

    def scan(k: int) -> tuple[dict[str, list[str]], Scan]:
        by_kind = files_of(k)
        return by_kind, _scan_kinds(spark, by_kind, **{o: v for o, v in kw.items() if o in SCAN_OPTIONS})

    out: dict[str, ImportResult] = {}
    if len(left) < 2 or kw.get("split_bytes"):  # such a size is the session's while text is read
        for k in left:
            out.update(_import_kinds(spark, store, files_of(k), run_id=ids[k], **kw))
        return out
    with ThreadPoolExecutor(1) as pool:
        ahead = in_thread(spark, pool, partial(scan, left[0]))
        for k, then in zip(left, [*left[1:], None]):
            by_kind, own = ahead.result()
            if then is not None:
                ahead = in_thread(spark, pool, partial(scan, then))
            out.update(_import_kinds(spark, store, by_kind, run_id=ids[k], scan=own, **kw))
    return out


def import_drop(spark: SparkSession, store: LedgerStore, folder: str, **kw) -> dict[str, ImportResult]:
    """S1 + S2 + U1: list ``folder``, route files by name and import both
    kinds together, in runs of bounded size (see ``_import_manifest``)."""
    from ..sources.manifest import list_csv, route
    return _import_manifest(spark, store, route(list_csv(spark, folder)), "file_name", **kw)


def import_prefix(spark: SparkSession, store: LedgerStore, prefix: str, **kw) -> dict[str, ImportResult]:
    """S6 + S1 + S2: every ``.csv`` object under ``prefix`` (recursively),
    taken as if landed in one folder by basename: on a basename collision
    the last key in key order wins. Then routing and import as in
    ``import_drop``."""
    from ..sources.manifest import flatten_by_basename, list_csv, route
    from ..sources.store import qualify
    keys = list_csv(spark, prefix, recursive=True).select(F.col("path").alias("key"))
    survivors = flatten_by_basename(keys, qualify(spark, prefix) + "/")
    return _import_manifest(spark, store, route(survivors.withColumnRenamed("key", "path"), name_col="basename"), "basename", **kw)
