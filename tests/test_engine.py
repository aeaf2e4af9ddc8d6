import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from tidelake.api import Api, ApiError
from tidelake.operators import ledger, observations, query, versions
from tidelake.operators.store import Store
from tidelake.plans import ask, refresh
from tidelake.sources import config, readers

SHIPMENTS = [("출하량", "모델A", "2024Q1", "한국", "기관A", "1,200"), ("출하량", "모델A", "2024Q2", "한국", "기관A", "1,350"), ("출하량", "모델B", "2024Q1", "한국", "기관A", "800"), ("출하량", "모델B", "2024Q2", "한국", "기관A", "910"), ("출하량", "모델C", "2024Q1", "북미", "기관B", "n.a."), ("출하량", "모델C", "2024Q2", "북미", "기관B", "430")]
FORECAST = {"2026-07": {"모델A": 100, "모델B": 200, "모델C": 150}, "2026-08": {"모델A": 100, "모델B": 250, "모델C": 120}}


def shipments(spark, rows):
    return spark.createDataFrame(rows, "metric string, entity string, period string, region string, source string, value string").withColumn("dataset", F.lit("shipments"))


def forecast(spark, labels, **changes):
    rows = [("forecast", "출하량전망", e, "2026Q3", float(changes.get(e, x)), label) for label in labels for e, x in FORECAST[label].items()]
    return spark.createDataFrame(rows, "dataset string, metric string, entity string, period string, value double, vintage string")


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}")


def test_snapshot_skips_and_diffs(spark, store):
    assert [r["status"] for r in store.snapshot(shipments(spark, SHIPMENTS))] == ["ok"]
    assert [r["status"] for r in store.snapshot(shipments(spark, SHIPMENTS[::-1]))] == ["skipped_duplicate"]
    changed = [("출하량", "모델A", "2024Q1", "한국", "기관A", "1,500"), *SHIPMENTS[1:5]]
    report = store.snapshot(shipments(spark, changed))[0]["report"]
    assert (report["rows"], report["dropped_blank"], report["changed"], report["removed"], report["added"]) == (4, 1, 1, 1, 0)
    assert report["top"][0]["entity"] == "모델A"
    assert [r.status for r in store.list_loads().collect()] == ["ok", "skipped_duplicate", "ok"]
    assert store.get_load(3)["report"]["changed"] == 1 and store.get_load(99) is None
    latest = query.query_observations(store.observations(), store.table("loads"), "shipments")
    assert latest.count() == 4


def test_dry_run_writes_nothing(spark, store):
    assert store.snapshot(shipments(spark, SHIPMENTS), dry_run=True)[0]["load_id"] is None
    assert store.table("loads").count() == 0 and store.observations().count() == 0


def test_versions(spark, store):
    assert [r["status"] for r in store.snapshot(forecast(spark, ["2026-07"]), "vintage")] == ["ok"]
    again = store.snapshot(forecast(spark, ["2026-07", "2026-08"]), "vintage")
    assert [(r["version_label"], r["status"]) for r in again] == [("2026-07", "skipped_duplicate"), ("2026-08", "ok")]
    assert again[1]["report"]["changed"] == 2 and again[1]["report"]["top"][0]["entity"] == "모델B"
    obs, loads = store.observations(), store.table("loads")
    for rank in ("abs", "rel"):
        rows, totals = versions.version_diff(obs, loads, "forecast", rank=rank)
        found = rows.collect()
        assert [r.entity for r in found] == ["모델B", "모델C"] and [r.pct for r in found] == [25.0, -20.0]
        assert tuple(totals.first()) == (2, 0, 0, 3)
    back, _ = versions.version_diff(obs, loads, "forecast", "2026-08", "2026-07")
    assert {r.entity: -r["diff"] for r in back.collect()} == {"모델B": 50.0, "모델C": -30.0}
    assert versions.version_diff(obs, loads, "forecast", "2026-08", "2026-08")[0].count() == 0
    reissue = store.snapshot(forecast(spark, ["2026-07"], 모델A=999), "vintage")[0]
    assert reissue["report"]["changed"] == 1
    loads, obs = store.table("loads"), store.observations()
    assert ledger.latest_id(loads, "forecast") == again[1]["load_id"]  # a late re-issue of an older label is not the latest
    points = versions.history(obs, loads, "forecast", "출하량전망", "모델A", "2026Q3").collect()
    assert [(p.version_label, p.value) for p in points] == [("2026-07", 999.0), ("2026-08", 100.0)]
    with pytest.raises(ValueError):
        versions.version_diff(obs, loads, "forecast", to_version="2026-07")


def test_history_of_unlabelled_loads(spark, store):
    for v in ("100", "110", "90"):
        store.snapshot(shipments(spark, [("m", "e", "2024Q1", "", "", v)]))
    points = versions.history(store.observations(), store.table("loads"), "shipments", "m", "e", "2024Q1").collect()
    assert [p.value for p in points] == [100.0, 110.0, 90.0]


def test_one_bad_key_does_not_stop_the_others(spark, store, monkeypatch):
    write = Store._write_rows
    monkeypatch.setattr(Store, "_write_rows", lambda self, good, keys: (_ for _ in ()).throw(RuntimeError("x" * 3000)) if any(p.dataset == "bad" for p in keys) else write(self, good, keys))
    both = shipments(spark, SHIPMENTS).union(shipments(spark, SHIPMENTS).withColumn("dataset", F.lit("bad")))
    out = store.snapshot(both)
    assert {r["dataset"]: r["status"] for r in out} == {"bad": "error", "shipments": "ok"}
    assert len(store.table("loads").where("status = 'error'").first().error) == 2000


def test_a_failed_key_is_no_baseline(spark, store, monkeypatch):
    compare = Store._compared

    def failing(self, good, keys):
        if any(p.label == "2026-08" for p in keys):
            raise RuntimeError("no")
        compare(self, good, keys)

    rows = forecast(spark, ["2026-07", "2026-08"]).union(forecast(spark, ["2026-08"], 모델A=7).withColumn("vintage", F.lit("2026-09")))
    monkeypatch.setattr(Store, "_compared", failing)
    out = store.snapshot(rows, "vintage")
    assert [(r["status"], r.get("report", {}).get("baseline")) for r in out] == [("ok", None), ("error", None), ("ok", out[0]["load_id"])]
    assert (out[2]["report"]["changed"], out[2]["report"]["added"], len(out[2]["report"]["top"])) == (3, 0, 3)
    monkeypatch.setattr(Store, "_compared", compare)
    again = store.snapshot(rows, "vintage")
    assert [r["status"] for r in again] == ["skipped_duplicate", "ok", "skipped_duplicate"] and again[1]["report"]["baseline"] == out[0]["load_id"]


def test_jobs_of_a_snapshot_do_not_grow_with_its_keys(spark, tmp_path):
    def jobs(n):
        rows = [(f"d{i % 3}", "m", f"e{j}", "2024", float(i + j), f"20{10 + i}-01") for i in range(n) for j in range(3)]
        df = spark.createDataFrame(rows, "dataset string, metric string, entity string, period string, value double, vintage string")
        store, group = Store(spark, f"file://{tmp_path}/{n}"), f"snapshot-{n}"
        store.snapshot(df, "vintage")
        spark.sparkContext.setJobGroup(group, group)
        out = store.snapshot(df.withColumn("value", F.col("value") + 1), "vintage")
        spark.sparkContext.setJobGroup("other", "other")
        assert [r["status"] for r in out] == ["ok"] * n and [r["report"]["changed"] for r in out] == [3] * n
        assert sorted(r["load_id"] for r in out) == list(range(n + 1, 2 * n + 1))
        assert store.observations().count() == 6 * n and store.table("reports").count() == 2 * n
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    few, many = jobs(3), jobs(24)
    assert many <= few + 6 and many < 60  # adaptive plans differ by a few jobs


def test_snapshots_of_a_label_by_turns(spark, store):
    for v, want in (("1", "ok"), ("2", "ok"), ("1", "ok"), ("1", "skipped_duplicate")):  # A-B-A is new, A-A is not
        assert store.snapshot(shipments(spark, [("m", "e", "2024Q1", "", "", v)]))[0]["status"] == want


def test_writers_at_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    def work(i):
        own = Store(spark, f"file://{tmp_path}/s")
        return [own.insert("ask_jobs", status="queued", message=f"{i}-{j}") for j in range(3)]

    with ThreadPoolExecutor(4) as pool:
        ids = [x for xs in pool.map(work, range(4)) for x in xs]
    store = Store(spark, f"file://{tmp_path}/s")
    assert len(set(ids)) == 12 and sorted(r.id for r in store.table("ask_jobs").collect()) == sorted(ids)
    with ThreadPoolExecutor(3) as pool:  # one of several workers gets a job
        got = list(pool.map(lambda _: Store(spark, f"file://{tmp_path}/s").update("ask_jobs", ids[0], F.col("status") == "queued", status="running"), range(3)))
    assert sorted(got) == [False, False, True]
    state = store.state("ask_jobs")
    assert not store.publish("ask_jobs", state[0], {"folders": [], "next": 1}) and store.state("ask_jobs") == state


def test_snapshots_at_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    def work(i):
        return Store(spark, f"file://{tmp_path}/s").snapshot(shipments(spark, [("m", "e", "2024Q1", "", "", str(i % 2))]))[0]

    with ThreadPoolExecutor(4) as pool:
        out = list(pool.map(work, range(4)))
    store = Store(spark, f"file://{tmp_path}/s")
    loads = store.table("loads").collect()
    assert len({r.id for r in loads}) == 4 and {r["load_id"] for r in out} == {r.id for r in loads}
    held = {r.load_id for r in store.observations().collect()}
    assert held == {r.id for r in loads if r.status == "ok"}
    assert not [p for p in (tmp_path / "s").iterdir() if p.name.startswith("staged-")]


def test_old_states_and_their_rows_go(spark, store, tmp_path, monkeypatch):
    from tidelake.operators import tables as module

    monkeypatch.setattr(module, "STATES", 3)
    for i in range(6):
        store.upsert("datasets", ["name"], spark.createDataFrame([("x", str(i), "")], "name string, title string, updated_at string"))
    left = {p.name for p in (tmp_path / "datasets").iterdir() if not p.name.startswith(".")}
    assert {x for x in left if x.startswith("v-")} == {"v-4", "v-5", "v-6"} and sum(x.startswith("w-") for x in left) == 3
    assert [r.title for r in store.table("datasets").collect()] == ["5"]


def test_rollup_mixes_and_pivots(spark):
    rows = [("m", "a", "", p, k, "s", v, "EA", i) for i, (p, k, v) in enumerate([("2025Q1", "20250100", 1.0), ("2025Q2", "20250400", 2.0), ("2025", "20250000", 10.0), ("x", "x", 5.0)])]
    df = spark.createDataFrame(rows, "metric string, entity string, region string, period string, period_sort string, source string, value double, unit string, seq long")
    got = {r.period: (r.value, r.period_sort) for r in query.rollup(df, "year").collect()}
    assert got == {"2025": (13.0, "20250000"), "x": (5.0, "x")}
    wide = query.to_wide(df, ["entity"], ["period"])
    assert wide.columns == ["entity", "2025", "2025Q1", "2025Q2", "x"] and list(wide.first()) == ["a", 10.0, 1.0, 2.0, 5.0]
    assert query.to_wide(df, ["nothing"], ["metric"]).columns == ["nothing", "m"]
    assert list(query.to_wide(df, ["entity"], ["metric"]).first()) == ["a", 5.0]  # the last in canonical order wins
    with pytest.raises(query.TooMany):
        query.to_wide(df, ["entity"], ["period"], cap=3)
    with pytest.raises(query.TooMany):
        query.fetch(df, 3)
    with pytest.raises(ValueError):
        query.rollup(df, "year", "max")


def test_fingerprint_ignores_order_and_sees_changes(spark):
    rows = observations.kept(observations.normalize_rows(shipments(spark, SHIPMENTS)))
    h = lambda df: df.agg(observations.fingerprint().alias("h")).first().h
    assert h(rows) == h(rows.orderBy(F.desc("value")).repartition(3)) != h(rows.limit(4)) and h(rows) != h(rows.union(rows.limit(1)))


def test_sources(spark, tmp_path):
    db = tmp_path / "s.sqlite"
    with sqlite3.connect(db) as c:
        c.execute("CREATE TABLE t (dataset, metric, entity, period, value, broker)")
        c.executemany("INSERT INTO t VALUES ('d', 'm', ?, '2024', ?, 'b')", [(f"e{i}", i) for i in range(5)])
    path = tmp_path / "source.yaml"
    path.write_text("db: s.sqlite\nview: t\nrename:\n  broker: source\n")
    rows = readers.read_source(spark, config.load_source(str(path)))
    assert rows.count() == 5 and "source" in rows.columns
    for bad in ("db: x\n", "db: x\nview: a b\n", "db: x\nview: a\nquery: SELECT 1\n", "view: t\n", "db: x\nview: t\nversion_column: ' '\n"):
        path.write_text(bad)
        with pytest.raises(config.ConfigError):
            config.load_source(str(path))
    with pytest.raises(config.ConfigError):
        readers.check_columns(spark.range(1))
    with pytest.raises(config.ConfigError):
        readers.rename_columns(spark.createDataFrame([(1, 2)], "a int, b int"), {"a": "b"})
    (tmp_path / "reports").mkdir()
    (tmp_path / "reports/b.md").write_text("﻿hello")
    (tmp_path / "reports/a.txt").write_text("x\ny")
    assert [r.text for r in readers.read_texts(spark, str(tmp_path / "reports")).collect()] == ["x\ny", "hello"]
    (tmp_path / ".env").write_text("# c\nA=1 # x\nB='q r'\n")
    assert config.read_env(str(tmp_path / ".env")) == {"A": "1", "B": "q r"}
    assert config.list_param("a, b,") == ["a", "b"] and config.list_param(" ") is None and config.int_param("", 3) == 3


def test_aliases():
    cfg = {"d": {"entities": {"삼성": ["모델A", "옛것"], "all": {"prefix": "모델"}}, "groups": {"g": "모델B"}}}
    assert config.resolve_aliases(cfg, "d", "entities", ["모델A", "모델B"]) == {"삼성": ["모델A"], "all": ["모델A", "모델B"], "g": ["모델B"]}


CATALOG = [{"name": "shipments", "title": "s", "metrics": ["출하량"], "entities": ["모델A", "모델B"], "regions": ["한국"], "sources": ["기관A"], "version_labels": [], "period_to": "2024Q2"}]


@pytest.mark.parametrize(
    ("message", "want"),
    [("모델A 추이", {"chart": "line", "rollup": None}), ("모델A 분기별 추이", {"rollup": "quarter"}), ("모델A 연도별", {"rollup": "year"}), ("모델A 지난 버전 대비", {"version": "diff"}), ("모델A 가장 많이 증가", {"version": "diff"}), ("2024 합계", {"rollup": "year", "period_from": "2024"}), ("모델A 모델B 비교", {"entities": ("모델A", "모델B")}), ("모델A 2024Q1 얼마", {"rows": (), "period_to": "2024Q1"}), ("안녕", None), ("모델A", None), ("모델A 모델B 추이", None)],
)
def test_rules(message, want):
    spec = ask.rule_spec(message, CATALOG)
    assert (spec is None) == (want is None)
    for k, x in (want or {}).items():
        assert getattr(spec, k) == x


def test_rules_need_one_dataset():
    other = {**CATALOG[0], "name": "other"}
    assert ask.rule_spec("모델A 추이", [*CATALOG, other]) is None


def test_templates_and_number_check():
    assert ask.say_diff([["모델B", 200.0, 250.0, 50.0, 25.0], ["모델C", 150.0, 120.0, -30.0, -20.0]], 1, ("2026-07", "2026-08")) == "가장 많이 바뀐 것은 모델B(+50, +25%)이고, 다음은 모델C(-30, -20%)입니다. (2026-07 → 2026-08)"
    assert ask.say_history([("2026-07", 100.0), ("2026-08", 120.0)], "모델A") == "모델A: 2026-07 100 → 2026-08 120 (+20, +20%)."
    assert ask.say_wide(["entity", "2024Q1", "2024Q2"], [["모델A", 100.0, 120.0]], 1) == "모델A: 2024Q1 100 → 2024Q2 120 (최고 2024Q2 120)."
    assert ask.say_wide(["entity", "p"], [["a", 1.0], ["b", 2.5]], 1) == "최댓값: b p 2.5, 최솟값: a p 1."
    assert ask.unknown_number("2024Q1 100.0과 25%", [["a", 100.0, 25.0]]) is None and ask.unknown_number("값 101", [["a", 100.0]]) == "101"
    assert ask.explain(["a"], [["x", 1.0]], lambda: "t", lambda table: "7") == ("t", ["explain_number_mismatch_used_template: '7' not in table"])


def test_questions_end_to_end(spark, store):
    store.snapshot(shipments(spark, SHIPMENTS))
    asked = []

    def resolver(message, datasets):
        asked.append(message)
        return ask.Spec("shipments", ("출하량",), ("모델B",), period_from="2024Q1", period_to="2024Q2")

    assistant = ask.Assistant(store, resolver=resolver)
    out = assistant.ask("모델A 추이")
    assert out["path"] == "rule" and out["rows"] == [["모델A", 1200.0, 1350.0]] and "1350" in out["sentence"] and out["chart"]["x"] == ["2024Q1", "2024Q2"]
    assert assistant.ask("알 수 없는 말")["path"] == "options"
    assert assistant.ask("에이전트 질문", use_resolver=True)["path"] == "resolver" and assistant.ask("에이전트질문")["path"] == "cache" and len(asked) == 1
    learned = store.table("learned_aliases").collect()
    assert [(r.phrase, r.targets, r.hit_count) for r in learned] == [("에이전트질문", ["모델B"], 1)]
    assistant.learn("에이전트 질문", ask.Spec("shipments", entities=("모델A", "모델B", "없는것")), assistant.catalog())
    assert [(r.targets, r.hit_count) for r in store.table("learned_aliases").collect()] == [(["모델A", "모델B"], 2)]
    assistant.learn("모델A 보여줘", ask.Spec("shipments", entities=("모델A",)), assistant.catalog())
    assert store.table("learned_aliases").count() == 1  # what a message names is not learned
    assert assistant.run(ask.Spec("shipments", ("출하량",), ("전혀다른이름",)))["clarify"]["options"]
    api = Api(assistant)
    assert api.get_query(dataset="shipments", entities="모델B")["rows"][0]["value"] == 800.0
    assert api.get_query(dataset="shipments", format="wide")["columns"] == ["entity", "2024Q1", "2024Q2"]
    assert api.get_catalog()[0]["entities"] == ["모델A", "모델B", "모델C"]
    assert api.get_suggestions("shipments")
    with pytest.raises(ApiError):
        api.get_query()
    with pytest.raises(ApiError):
        api.get_version_diff(dataset="shipments")
    job = api.post_ask("모델A 추이")
    assert api.get_ask(job)["position"] == 1
    assert api.jobs.run_next() == job and json.loads(json.dumps(api.get_ask(job)["result"]))["path"] == "rule"
    other = api.post_ask("x")
    api.delete_ask(other)
    assert api.jobs.run_next() is None
    assert [j["id"] for j in api.get_recent_jobs()] == [other, job] and api.get_aliases()["learned"][0]["hit_count"] == 2
    assert assistant.digest() == 0 and api.get_digest("shipments") == []  # a first load has nothing to compare
    changed = [("출하량", "모델A", "2024Q1", "한국", "기관A", "1,500"), *SHIPMENTS[1:]]
    assert api.post_refresh(lambda: shipments(spark, changed), command="x", runner=lambda c: (3, "no"))["stage"] == "command"
    assert store.table("loads").count() == 1
    done = api.post_refresh(lambda: shipments(spark, changed), command="true")
    assert done["ok"] and refresh.summary(done["results"]) == ["shipments: 5 rows (0 added, 0 removed, 1 changed)"]
    assert assistant.digest() == 1 and assistant.digest() == 0
    found = api.get_digest("shipments")
    assert [x["kind"] for x in found] == ["load_summary", "entity_note"] and "모델A(+300, +25%)" in found[0]["sentence"]
    assert refresh.log_call(store, "ask", "ok", 1.5, 3, 4) == 2 and refresh.metric_lines(store.table("call_log").where("id = 2").select("id", "latency", "status")) == ["id=2 latency=1.5 status=ok"]  # 1 is the resolver's call


def test_versions_by_id_belong_to_their_dataset(spark, store):
    store.snapshot(shipments(spark, SHIPMENTS))
    store.snapshot(shipments(spark, SHIPMENTS).withColumn("dataset", F.lit("other")))
    loads = store.table("loads")
    assert ledger.resolve_version(loads, "shipments", 1) == 1 and ledger.resolve_version(loads, "other", "2") == 2
    for wrong in (2, "99"):
        with pytest.raises(ValueError):
            ledger.resolve_version(loads, "shipments", wrong)


def test_version_digest_says_what_changed(spark, store):
    store.snapshot(forecast(spark, ["2026-07"]), "vintage")
    assistant = ask.Assistant(store)
    assert assistant.digest() == 0
    store.snapshot(forecast(spark, ["2026-07", "2026-08"]), "vintage")
    assert assistant.digest() == 1
    found = assistant.latest_digests("forecast")
    assert found[0]["sentence"] == "가장 많이 바뀐 것은 모델B(+50, +25%)이고, 다음은 모델C(-30, -20%)입니다. (2026-07 → 2026-08)"
    assert [x["entity"] for x in found] == [None, "모델B", "모델C"]


def test_resolver_is_shown_a_narrowed_catalog():
    many = [{**CATALOG[0], "entities": [f"모델{i:03d}" for i in range(100)], "period_from": "2023Q1"}, {**CATALOG[0], "name": "other", "period_from": None}]
    shown = ask.narrowed("모델007 추이", [{"role": "user", "content": "x"}], many)
    assert len(shown["entities"]) == ask.NARROW and "모델007" in shown["entities"] and shown["metrics"] == ["출하량"] and shown["period_from"] == "2023Q1"
    prompt = ask.resolver_prompt("모델007 추이", [], shown)
    assert [m["role"] for m in prompt] == ["system", "user"] and "모델007" in prompt[1]["content"] and "rollup" in prompt[0]["content"]


def test_many_inserted_rows(spark, store, monkeypatch):
    from tidelake.operators import tables as module

    monkeypatch.setattr(module, "FILES", 4)
    assert [store.insert("ask_jobs", status="queued", message=str(i)) for i in range(6)] == list(range(1, 7))
    store.update("ask_jobs", 2, status="done")
    assert [(r.id, r.message, r.status) for r in store.table("ask_jobs").orderBy("id").collect()] == [(i + 1, str(i), "done" if i == 1 else "queued") for i in range(6)]


def test_a_model_is_shown_what_it_needs_and_its_calls_are_logged(spark, store):
    store.snapshot(shipments(spark, SHIPMENTS))
    said, answers = [], ['<think>{</think>```json\n{"dataset": "shipments", "metrics": ["출하량"], "entities": ["모델B"], "version": "latest"}```', '{"clarify": "which one?"}', "no form", '{"dataset": 5, "metrics": "x"}']

    def model(prompt):
        said.append(prompt)
        return answers[len(said) - 1]

    assistant = ask.Assistant(store, model=model)
    out = assistant.ask("그건 어때", use_resolver=True, history=[{"role": "user", "content": "모델B 말이야"}])
    assert out["path"] == "resolver" and [r[0] for r in out["rows"]] == ["모델B"]
    assert "모델B 말이야" in said[0][1]["content"] and "모델C" in said[0][1]["content"] and store.table("spec_cache").count() == 0
    assert assistant.ask("그건", use_resolver=True)["clarify"]["question"] == "which one?"
    assert assistant.ask("그건", use_resolver=True)["path"] == "options" and assistant.ask("그건", use_resolver=True)["path"] == "options"
    assert [(r.step, r.status) for r in store.table("call_log").orderBy("id").collect()] == [("resolve", x) for x in ("ok", "ok", "invalid", "invalid")]
    broken = ask.Assistant(store, model=lambda prompt: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        broken.ask("그건", use_resolver=True)
    assert store.table("call_log").where("status = 'error'").count() == 1
    api = Api(ask.Assistant(store, model=lambda prompt: answers[0] if "앞서" in prompt[1]["content"] else ""))
    job = api.post_ask("저건", history=[{"role": "user", "content": "앞서"}])
    assert api.jobs.run_next() == job and api.get_ask(job)["result"]["path"] == "resolver"


def test_the_level_report(spark):
    rows = [(1, True, 2.0, 10.0, "stop", 40, 4, None), (1, False, 3.0, 10.0, "stop", None, None, "429"), (2, True, 1.0, 5.0, "length", 20, None, None)]
    calls = spark.createDataFrame(rows, "level long, ok boolean, latency double, wall double, finish_reason string, completion_tokens long, reasoning_tokens long, error_class string")
    lines = refresh.laid_out(refresh.level_report(calls), refresh.LEVEL_COLUMNS)
    assert len(lines) == 4 and len({len(x) for x in lines}) == 1
    assert lines[2].split() == ["1", "1/2", "10.0", "2.5", "2.9", "40", "4.0", "20.0", "0", "4.0/4", "429=1"] and lines[3].split()[-1] == "none"
