"""The service's calls as functions of plain values; a transport is left to the caller. Errors are (status, message)."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame

from .operators import query, versions
from .plans.ask import Assistant, Jobs, Spec
from .plans.refresh import refresh
from .schema import CELL_CAP, ROW_CAP
from .sources.config import int_param, list_param


class ApiError(Exception):
    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


class Api:
    def __init__(self, assistant: Assistant):
        self.assistant, self.store = assistant, assistant.store
        self._refreshing = threading.Lock()
        self.jobs = Jobs(self.store, lambda m, history: assistant.ask(m, use_resolver=True, history=history))

    def _dataset(self, params: dict) -> str:
        if not params.get("dataset"):
            raise ApiError(400, "dataset is needed")
        return params["dataset"]

    def get_catalog(self) -> list[dict]:
        return self.assistant.catalog()

    def get_query(self, **params) -> dict:
        """Rows, or with format=wide a pivot of rows by cols; both capped."""
        lists = {k: list_param(params.get(k)) for k in ("metrics", "entities", "regions", "sources")}
        try:
            df = query.query_observations(self.store.observations(), self.store.table("loads"), self._dataset(params), period_from=params.get("from"), period_to=params.get("to"), version=params.get("version") or "latest", level=params.get("rollup"), agg=params.get("agg") or "sum", **lists)
            rows = query.fetch(df, ROW_CAP)
            if params.get("format") == "wide":
                wide = query.to_wide(df, list_param(params.get("rows")) or ["entity"], list_param(params.get("cols")) or ["period"], CELL_CAP)
                return {"columns": wide.columns, "rows": [list(r) for r in wide.collect()]}
        except ValueError as e:
            raise ApiError(400, str(e)) from e
        return {"rows": [r.asDict() for r in rows]}

    def get_history(self, **params) -> list[dict]:
        if missing := [k for k in ("metric", "entity", "period") if not params.get(k)]:
            raise ApiError(400, f"needed: {missing}")
        df = versions.history(self.store.observations(), self.store.table("loads"), self._dataset(params), params["metric"], params["entity"], params["period"], params.get("source"))
        return [r.asDict() for r in df.collect()]

    def get_version_diff(self, **params) -> dict:
        lists = {k: list_param(params.get(k)) for k in ("metrics", "entities", "regions", "sources")}
        try:
            rows, totals = versions.version_diff(self.store.observations(), self.store.table("loads"), self._dataset(params), params.get("from"), params.get("to") or "latest", list_param(params.get("group_by")), params.get("rank") or "abs", int_param(params.get("top"), versions.TOP), **lists)
        except ValueError as e:
            raise ApiError(400, str(e)) from e
        return {"rows": [r.asDict() for r in rows.collect()], "totals": totals.first().asDict()}

    def get_loads(self, load_id: int | None = None, dataset: str | None = None):
        if load_id is None:
            return [r.asDict() for r in self.store.list_loads(dataset).collect()]
        found = self.store.get_load(load_id)
        if found is None:
            raise ApiError(404, "no such load")
        return found

    def get_suggestions(self, dataset: str) -> list[dict]:
        d = next((x for x in self.get_catalog() if x["name"] == dataset), None)
        return [] if d is None else [{"label": s["label"], "spec_patch": asdict(s["spec"])} for s in self.assistant.suggestions(d)]

    def post_chat(self, message: str | None = None, spec: dict | None = None, history: list[dict] | None = None) -> dict:
        if spec is not None:
            form, datasets = Spec(**{k: tuple(v) if isinstance(v, list) else v for k, v in spec.items()}), self.get_catalog()
            out = self.assistant.run(form, datasets) | {"path": "button"}
            if out.get("rows") and (message or "").strip():  # the question that led to the button
                self.assistant.learn(message, form, datasets)
            return out
        if not (message or "").strip():
            raise ApiError(400, "message is needed")
        return self.assistant.ask(message, history=history)

    def post_ask(self, message: str, history: list[dict] | None = None) -> int:
        return self.jobs.submit(message, history)

    def get_ask(self, job_id: int) -> dict:
        found = self.jobs.status(job_id)
        if found is None:
            raise ApiError(404, "no such job")
        return found

    def delete_ask(self, job_id: int) -> None:
        if not self.jobs.cancel(job_id):
            raise ApiError(404, "no such job, or it has ended")

    def get_recent_jobs(self, **params) -> list[dict]:
        return self.jobs.recent(int_param(params.get("recent"), 20))

    def get_digest(self, dataset: str | None = None) -> list[dict]:
        return self.assistant.latest_digests(self._dataset({"dataset": dataset}))

    def get_aliases(self) -> dict:
        """The configured aliases, and those learned with their hits."""
        return {"aliases": self.assistant.aliases, "learned": [r.asDict() for r in self.store.table("learned_aliases").orderBy("id").collect()]}

    def post_refresh(self, read: Callable[[], DataFrame], **settings) -> dict:
        """Refresh once, unless a refresh is under way."""
        if not self._refreshing.acquire(blocking=False):
            raise ApiError(409, "a refresh is under way")
        try:
            return refresh(self.store, read, **settings)
        finally:
            self._refreshing.release()

    def delete_learned_alias(self, alias_id: int) -> None:
        self.store.delete("learned_aliases", alias_id)
