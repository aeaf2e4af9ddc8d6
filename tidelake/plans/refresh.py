"""A refresh: a preceding command, then a snapshot; its log and what is said of it, and the log of model calls."""

from __future__ import annotations

import subprocess
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.calls import errors_by_class, level_stats
from ..operators.store import Store, now


def _run(command: str) -> tuple[int, str]:
    done = subprocess.run(command, shell=True, capture_output=True)  # noqa: S602  the operator's own command
    return done.returncode, b"".join([done.stdout, done.stderr]).decode("utf-8", "replace")


def refresh(store: Store, read: Callable[[], DataFrame], command: str | None = None, log: str | None = None, runner: Callable[[str], tuple[int, str]] = _run, **snapshot) -> dict:
    """ok, stage, results: the snapshot of what read gives, taken only if the command before it ends with 0; its output is added to the log."""
    if command:
        code, said = runner(command)
        if log:
            with Path(log).open("a", encoding="utf-8") as f:
                f.write(f"[{now()}] {command}: {code}\n{said}\n")
        if code:
            return {"ok": False, "stage": "command", "returncode": code, "results": []}
    results = store.snapshot(read(), **snapshot)
    return {"ok": not any(r["status"] == "error" for r in results), "stage": "snapshot", "results": results}


def summary(results: list[dict]) -> list[str]:
    """A line for each dataset and label of a snapshot."""
    lines = []
    for r in results:
        report = r.get("report") or {}
        said = {"skipped_duplicate": "unchanged", "error": f"error: {r.get('error')}"}.get(r["status"], f"{report.get('rows', 0)} rows")
        if "changed" in report:
            said += " (" + ", ".join(f"{report[k]} {k}" for k in ("added", "removed", "changed")) + ")"
        lines.append(" ".join(filter(None, [r["dataset"], r.get("version_label") and f"[{r['version_label']}]"])) + f": {said}")
    return lines


def log_call(store: Store, step: str, status: str, latency: float | None = None, prompt_tokens: int | None = None, completion_tokens: int | None = None) -> int:
    """Add a model call to the call log."""
    return store.insert("call_log", step=step, status=status, latency=latency, prompt_tokens=prompt_tokens, completion_tokens=completion_tokens, created_at=now())


def metric_lines(rows: DataFrame) -> list[str]:
    """The rows of a metrics table, one line each, as name=value; null as a dash."""
    return [" ".join(f"{k}={'-' if v is None else v}" for k, v in r.asDict().items()) for r in rows.collect()]


# What the columns of the level report and of the quality report are called.
LEVEL_COLUMNS = {"level": "level", "done": "ok/all", "wall_sec": "wall s", "p50_latency_sec": "p50 s", "p90_latency_sec": "p90 s", "completion_tokens_sum": "tokens", "aggregate_tokens_per_sec": "tok/s", "mean_call_tokens_per_sec": "tok/s a call", "truncated": "cut", "reasoning": "reasoning mean/max", "errors": "errors"}


def level_report(calls: DataFrame) -> DataFrame:
    """The level report of call records as text columns: one row a level, its errors by class, most frequent first."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    one = F.concat_ws("=", "error_class", F.col("n").cast("string"))
    errors = errors_by_class(calls).groupBy("level").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("order"), "error_class", one.alias("text")))).alias("e"))
    rows = level_stats(calls).join(errors.select("level", F.array_join(F.transform("e", lambda x: x["text"]), " ").alias("errors")), "level", "left")
    rows = rows.withColumns({"done": F.concat_ws("/", F.col("success_count").cast("string"), F.col("total_count").cast("string")), "reasoning": F.concat_ws("/", shown("reasoning_tokens_mean"), shown("reasoning_tokens_max")), "errors": F.coalesce("errors", F.lit("none"))})
    return rows.orderBy("level").select(*(shown(c).alias(c) for c in LEVEL_COLUMNS))


def laid_out(rows: DataFrame, titles: dict[str, str]) -> list[str]:
    """A small table as lines: a header, a rule, and cells under their titles, to the right."""
    cells = [list(titles.values()), *([str(r[c]) for c in titles] for r in rows.collect())]
    wide = [max(len(x[i]) for x in cells) for i in range(len(titles))]
    lines = ["  ".join(x.rjust(w) for x, w in zip(row, wide, strict=True)) for row in cells]
    return [lines[0], "  ".join("-" * w for w in wide), *lines[1:]]
