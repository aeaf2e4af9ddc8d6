"""A versioned store of observations in Parquet: immutable loads and a ledger that commits them.

Observations of a load are written first, its ledger row last; readers go through
the ledger, so what a failed run leaves is never seen. Load ids are reserved before
anything is written, so writers at the same time never write to one load.
"""

from __future__ import annotations

import datetime
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.periods import parse
from ..schema import DATASETS, DIM_FIELDS, LOADS, OBSERVATIONS, REPORTS
from . import ledger, observations
from .scratch import discard, written
from .tables import Tables


def _fields(text: str) -> T.StructType:
    kinds = {"long": T.LongType(), "string": T.StringType(), "double": T.DoubleType(), "strings": T.ArrayType(T.StringType())}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split(":") for x in text.split())])


TABLES = {
    "loads": LOADS,
    "datasets": DATASETS,
    "reports": REPORTS,
    "learned_aliases": _fields("id:long dataset:string dim:string phrase:string targets:strings hit_count:long updated_at:string"),
    "spec_cache": _fields("message_key:string catalog_version:string spec:string"),
    "digests": _fields("id:long load_id:long dataset:string kind:string entity:string sentence:string table_json:string created_at:string"),
    "ask_jobs": _fields("id:long status:string message:string history:string result:string error:string created_at:string started_at:string finished_at:string"),
    "call_log": _fields("id:long step:string status:string latency:double prompt_tokens:long completion_tokens:long created_at:string"),
}


def now() -> str:
    return datetime.datetime.now().strftime("%Y-%m-%dT%H:%M:%S")


@dataclass
class Planned:
    """What becomes of one (dataset, label) of a snapshot. base is the load it is compared with, base_label that label's rows of the same snapshot."""

    dataset: str
    label: str
    digest: str
    stats: dict
    order: str = ""
    load_id: int | None = None
    status: str = "ok"
    base: int | None = None
    base_label: str | None = None
    error: str | None = None
    report: dict = field(default_factory=dict)


class Store(Tables):
    """Tables below a root path that Spark reads and writes."""

    def __init__(self, spark: SparkSession, root: str):
        super().__init__(spark, root, TABLES)

    # -- observations --------------------------------------------------------------------------

    def observations(self) -> DataFrame:
        """All observations of committed loads, partitioned by dataset and load."""
        path = f"{self.root}/observations"
        fs, p = self._fs(path)
        if not fs.exists(p):
            return self.spark.createDataFrame([], OBSERVATIONS)
        return self.spark.read.schema(OBSERVATIONS).parquet(path).select([f.name for f in OBSERVATIONS.fields])

    def write_skip(self, dataset: str, content_hash: str, label: str, version_sort: str, started_at: str) -> int:
        return self.insert("loads", dataset=dataset, content_hash=content_hash, rows=0, status="skipped_duplicate", started_at=started_at, finished_at=now(), version_label=label, version_sort=version_sort)

    def write_error(self, dataset: str, label: str, error: str, started_at: str) -> int:
        return self.insert("loads", dataset=dataset, content_hash="", rows=0, status="error", error=error[:2000], started_at=started_at, finished_at=now(), version_label=label, version_sort="")

    def upsert_dataset(self, name: str, title: str | None = None) -> None:
        self.upsert("datasets", ["name"], self.spark.createDataFrame([(name, title or name, now())], DATASETS))

    # -- snapshots -----------------------------------------------------------------------------

    def snapshot(self, source: DataFrame, version_column: str | None = None, seq: str | None = None, dry_run: bool = False) -> list[dict]:
        """Normalise a source and write a load for each (dataset, label) whose content is new; one key's failure does not stop the others.

        The number of Spark jobs is the same whatever the number of keys: the source
        is normalised and written once, one comparison and one partitioned write
        hold all keys, and the ledger gets all its rows in one commit. Only if a
        step fails are the keys halved until the failing ones are alone. The
        driver holds facts about keys, never observations.
        """
        started = now()
        rows = written(observations.normalize_rows(source, version_column, seq), "normal")
        try:
            stats = {(r.dataset, r.version_label): r.asDict() for r in observations.ingest_stats(rows).collect()}
            good = observations.kept(rows)
            hashes = {(r.dataset, r.version_label): r.content_hash for r in observations.content_hashes(good).collect()}
            first = None if dry_run or not stats else self.reserve("loads", len(stats))
            keys = [Planned(d, v, hashes.get((d, v), ""), stats[d, v], load_id=None if first is None else first + i) for i, (d, v) in enumerate(sorted(stats))]
            seen = self.state("loads")[0]
            plan = self._planned(keys, started)
            self._isolated(lambda some: self._compared(good, some), [p for p in plan if p.status == "ok"])
            if any(p.status == "error" for p in plan):  # what was to be compared with a failed key has another baseline
                again = self._planned(plan, started)
                moved = [p for p, q in zip(again, plan, strict=True) if p.status == "ok" and (p.base, p.base_label) != (q.base, q.base_label)]
                plan = again
                self._isolated(lambda some: self._compared(good, some), moved)
            if not dry_run:
                self._isolated(lambda some: self._write_rows(good, some), [p for p in plan if p.status == "ok"])
                self._committed(plan, started, seen)
            return [self._outcome(p, dry_run) for p in plan]
        finally:
            discard(rows)

    def _outcome(self, p: Planned, dry_run: bool) -> dict:
        out = {"dataset": p.dataset, "version_label": p.label, "status": p.status, "load_id": None if dry_run else p.load_id}
        return out | ({"error": p.error} if p.status == "error" else {"report": p.report} if p.status == "ok" else {})

    def _known(self, datasets: list[str]) -> list:
        """The newest ok load of each label and sort of some datasets; one row each."""
        own = ledger.ok_loads(self.table("loads")).where(F.col("dataset").isin(datasets))
        return own.groupBy("dataset", "version_label", "version_sort").agg(F.max(F.struct("id", "content_hash")).alias("x"), F.min("id").alias("oldest")).select("dataset", "version_label", "version_sort", "x.*", "oldest").collect()

    def _planned(self, keys: list[Planned], started: str) -> list[Planned]:
        """Which keys are new, and what each is compared with: the newest load of the same sort, else of the next lower, those of this snapshot included."""
        newest: dict[tuple[str, str], tuple[int, str]] = {}
        sorts: dict[tuple[str, str], tuple[int, str]] = {}
        loads: dict[str, list[tuple[str, int, str | None]]] = {}
        for r in self._known(sorted({k.dataset for k in keys})) if keys else []:
            key = (r.dataset, r.version_label)
            newest[key] = max(newest.get(key, (0, "")), (r.id, r.content_hash))
            sorts[key] = min(sorts.get(key, (r.oldest, r.version_sort)), (r.oldest, r.version_sort))
            loads.setdefault(r.dataset, []).append((r.version_sort, r.id, None))
        out = []
        for k in keys:
            key = (k.dataset, k.label)
            if k.status == "error":
                out.append(k)
                continue
            _, sort, ok = parse(k.label)
            order = "" if k.label == "" else f"P{sort}" if ok else sorts[key][1] if key in sorts else f"F{started}"
            if key in newest and newest[key][1] == k.digest:
                out.append(replace(k, order=order, status="skipped_duplicate"))
                continue
            below = max((x for x in loads.get(k.dataset, []) if x[0] <= order), key=lambda x: x[:2], default=None)
            base = {"base": below and below[1], "base_label": below and below[2]}
            out.append(replace(k, order=order, report={**{n: v for n, v in k.stats.items() if n not in ("dataset", "version_label")}, "baseline": base["base"]} if (k.base, k.base_label) != tuple(base.values()) or not k.report else k.report, **base))
            if k.load_id is not None:
                loads.setdefault(k.dataset, []).append((order, k.load_id, k.label))
        return out

    def _isolated(self, step: Callable[[list[Planned]], None], keys: list[Planned]) -> None:
        """Run a step on all keys at once; if it fails, on halves, until a key that fails is alone and is marked."""
        if not keys:
            return
        try:
            step(keys)
        except Exception as e:  # recorded in the ledger; the other keys go on
            if len(keys) == 1:
                keys[0].status, keys[0].error = "error", str(e)[:2000]
                return
            self._isolated(step, keys[: len(keys) // 2])
            self._isolated(step, keys[len(keys) // 2 :])

    def _compared(self, good: DataFrame, keys: list[Planned]) -> None:
        """Add to each key's report how it differs from its baseline: one comparison for all of them."""
        keys = [p for p in keys if p.base is not None]
        if not keys:
            return
        spark = self.spark
        named = spark.createDataFrame([(i, p.dataset, p.label, p.base, p.base_label) for i, p in enumerate(keys)], "k int, dataset string, version_label string, base long, base_label string")
        side = lambda df, new: df.select("k", *DIM_FIELDS, "value", "seq", F.lit(new).alias("new"))
        rows = side(good.join(named, ["dataset", "version_label"]), True)
        siblings = named.where("base_label IS NOT NULL").select("k", "dataset", F.col("base_label").alias("version_label"))
        rows = rows.union(side(good.join(siblings, ["dataset", "version_label"]), False))
        stored = sorted({p.base for p in keys if p.base_label is None})
        if stored:  # their partitions alone are read
            old = self.observations().where(F.col("load_id").isin(stored)).withColumnRenamed("load_id", "base")
            rows = rows.union(side(old.join(named.where("base_label IS NULL").select("k", "dataset", "base"), ["dataset", "base"]), False))
        changes = written(observations.compare_sides(rows, ["k", *DIM_FIELDS]).where("change != 'same'"), "changes")
        counts = {r.k: r.asDict() for r in changes.groupBy("k").agg(*(F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "changed"))).collect()}
        found: dict = {}
        for r in observations.top_by_group(observations.with_relative(changes.where("change = 'changed'")), "k", [F.desc("relative"), *DIM_FIELDS], observations.TOP).collect():
            found.setdefault((r.k, "top"), []).append({n: v for n, v in r.asDict().items() if n != "k"})
        for c in ("added", "removed"):
            for r in observations.top_by_group(changes.where(F.col("change") == c).select("k", *DIM_FIELDS), "k", list(DIM_FIELDS), observations.LISTED).collect():
                found.setdefault((r.k, f"{c}_keys"), []).append([r[x] for x in DIM_FIELDS])
        for i, p in enumerate(keys):
            p.report |= {c: counts.get(i, {}).get(c, 0) for c in ("added", "removed", "changed")} | {n: found.get((i, n), []) for n in ("top", "added_keys", "removed_keys")}
        discard(changes)

    def _write_rows(self, good: DataFrame, keys: list[Planned]) -> None:
        """The observations of all keys in one write, a partition for each load.

        They are written to a folder of their own and each load's partition is then
        moved to its place, as Spark's writers share a temporary folder below their
        target and the first of several to end would delete it.
        """
        ids = self.spark.createDataFrame([(p.dataset, p.label, p.load_id) for p in keys], "dataset string, version_label string, load_id long")
        shaped = good.join(ids, ["dataset", "version_label"]).select([f.name for f in OBSERVATIONS.fields])
        order, staged = ["load_id", "metric", "entity", "period_sort"], f"{self.root}/staged-{uuid.uuid4().hex}"
        fs, top = self._fs(staged)
        try:
            shaped.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("dataset", "load_id").parquet(staged)
            for dataset in [x.getPath() for x in fs.listStatus(top) if x.isDirectory()]:
                _, target = self._fs(f"{self.root}/observations/{dataset.getName()}")
                fs.mkdirs(target)
                for load in [x.getPath() for x in fs.listStatus(dataset)]:
                    if not fs.rename(load, self.spark._jvm.org.apache.hadoop.fs.Path(target, load.getName())):
                        raise RuntimeError(f"could not move {load} to {target}")
        finally:
            fs.delete(top, True)

    def _committed(self, plan: list[Planned], started: str, seen: int) -> None:
        """All ledger rows at once. If other writers came first, a key that they gave the same content is a duplicate and its rows go."""
        if not plan:
            return
        if self.state("loads")[0] != seen:
            newest: dict = {}
            for r in self._known(sorted({p.dataset for p in plan})):
                newest[r.dataset, r.version_label] = max(newest.get((r.dataset, r.version_label), (0, "")), (r.id, r.content_hash))
            for p in plan:
                if p.status == "ok" and newest.get((p.dataset, p.label), (0, ""))[1] == p.digest:
                    p.status = "skipped_duplicate"
                    folder = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(p.dataset)
                    fs, path = self._fs(f"{self.root}/observations/dataset={folder}/load_id={p.load_id}")
                    fs.delete(path, True)
        names = sorted({p.dataset for p in plan})
        self.upsert("datasets", ["name"], self.spark.createDataFrame([(n, n, now()) for n in names], DATASETS))
        ok = [p for p in plan if p.status == "ok"]
        if ok:
            self.append("reports", self.spark.createDataFrame([(p.load_id, json.dumps(p.report, ensure_ascii=False)) for p in ok], REPORTS))
        rows = [(p.load_id, p.dataset, "" if p.status == "error" else p.digest, p.stats["rows"] if p.status == "ok" else 0, p.status, p.error, started, now(), p.label, "" if p.status == "error" else p.order) for p in plan]
        self.append("loads", self.spark.createDataFrame(rows, LOADS))

    def get_load(self, load_id: int) -> dict | None:
        row = self.table("loads").where(F.col("id") == load_id).join(self.table("reports").withColumnRenamed("load_id", "id"), "id", "left").first()
        return None if row is None else row.asDict() | {"report": json.loads(row.report) if row.report else None}

    def list_loads(self, dataset: str | None = None) -> DataFrame:
        loads = self.table("loads")
        return (loads if dataset is None else loads.where(F.col("dataset") == dataset)).orderBy(F.desc("id"))
