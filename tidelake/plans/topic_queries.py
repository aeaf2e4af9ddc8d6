"""Registered queries of topics, networks, neighbours and ranking, over the given tables, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import neighbours, network, ranking, topics
from ..operators.scratch import written
from . import views as v
from .suite import register

KEYS = ["entity", "theme"]
MENTIONS_SQL = """mentions AS (
  SELECT p_brand AS entity, p_type AS theme, datediff('day', DATE '1970-01-05', CAST(l_shipdate AS DATE)) // 7 AS week, l_suppkey AS speaker,
         CASE WHEN l_discount >= 0.07 THEN -1 WHEN l_tax >= 0.06 THEN 1 ELSE 0 END AS direction, CASE WHEN l_quantity > 40 THEN CAST(l_quantity AS BIGINT) - 45 END AS change
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def mentions(spark: SparkSession, d: str) -> DataFrame:
    """A line is a mention of its part's brand and kind by its supplier, in the week of shipping; discounts speak down, taxes up, large quantities change a judgement."""
    lines = v.table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate", "l_discount", "l_tax", "l_quantity")
    parts = v.table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("entity"), F.col("p_type").alias("theme"))
    way = F.when(F.col("l_discount") >= 0.07, -1).when(F.col("l_tax") >= 0.06, 1).otherwise(0)
    change = F.when(F.col("l_quantity") > 40, F.col("l_quantity").cast("long") - 45)
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(*KEYS, topics.week_of(F.col("l_shipdate")).alias("week"), F.col("l_suppkey").alias("speaker"), way.alias("direction"), change.alias("change"))


@register("topic_burst", f"""WITH {MENTIONS_SQL},
counts AS (SELECT entity, theme, week, count(*) AS n FROM mentions GROUP BY ALL),
ends AS (SELECT min(week) AS first, max(week) AS last FROM counts),
dense AS (SELECT entity, theme, week, coalesce(n, 0) AS n FROM (SELECT entity, theme, unnest(range(min(week), (SELECT last FROM ends) + 1)) AS week FROM counts GROUP BY 1, 2) LEFT JOIN counts USING (entity, theme, week)),
m AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY entity, theme ORDER BY week RANGE BETWEEN 8 PRECEDING AND 1 PRECEDING), 0)::DOUBLE / nullif(least(8, week - (SELECT first FROM ends)), 0) AS mean FROM dense)
SELECT entity, theme, week, n, round(mean, 6) AS mean, round(CASE WHEN mean > 0 THEN n / mean END, 6) AS burst FROM m""")
def _(spark, d):
    return topics.weekly_burst(mentions(spark, d), KEYS).withColumns({c: F.round(c, 6) for c in ("mean", "burst")})


_SIGNALS_SQL = """SELECT entity, theme, count(*) AS n, count(DISTINCT speaker) AS breadth, count(*) FILTER (direction > 0) AS up, count(*) FILTER (direction < 0) AS down,
       count(change) AS changes, CAST(coalesce(sum(abs(change)), 0) AS BIGINT) AS change_size FROM mentions GROUP BY 1, 2"""


@register("topic_signals", f"WITH {MENTIONS_SQL}, s AS ({_SIGNALS_SQL}) SELECT *, round(CASE WHEN greatest(up, down) > 0 THEN least(up, down) / greatest(up, down) ELSE 0.0 END, 6) AS disagreement FROM s")
def _(spark, d):
    return topics.signals(mentions(spark, d), KEYS).drop("speakers").withColumn("disagreement", F.round("disagreement", 6))


@register("topic_breadth_merged", f"WITH {MENTIONS_SQL} SELECT entity, count(DISTINCT speaker) AS breadth, true AS within_error FROM mentions GROUP BY 1")
def _(spark, d):
    """Sketches by theme and week, merged to one a brand, beside the exact number: four standard errors hold for all."""
    found = mentions(spark, d)
    weekly = topics.signals(found, [*KEYS, "week"])
    exact = topics.signals(found, ["entity"]).select("entity", "breadth")
    off = F.abs(F.col("breadth_estimate") - F.col("breadth")) <= F.greatest(F.lit(1.0), 4 * topics.relative_error() * F.col("breadth"))
    return topics.merged(weekly, ["entity"]).join(exact, "entity").select("entity", "breadth", off.alias("within_error"))


def _pmi_sql(source: str, least: int, pmi: float) -> str:
    return f"""once AS ({source}), total AS (SELECT count(DISTINCT doc) AS total FROM once),
n AS (SELECT topic, count(*) AS n FROM once GROUP BY 1 HAVING count(*) >= {least}),
pairs AS (SELECT x.topic AS a, y.topic AS b, count(*) AS n_ab FROM (SELECT * FROM once SEMI JOIN n USING (topic)) x JOIN (SELECT * FROM once SEMI JOIN n USING (topic)) y ON x.doc = y.doc AND x.topic < y.topic GROUP BY 1, 2 HAVING count(*) >= {least}),
pmis AS (SELECT a, b, p.n AS n_a, q.n AS n_b, n_ab, ln(n_ab * total::DOUBLE / (p.n * q.n)) AS pmi FROM pairs JOIN n p ON a = p.topic JOIN n q ON b = q.topic, total),
found AS (SELECT * FROM pmis WHERE pmi >= {pmi} - 1e-12)"""


_BASKETS = "SELECT DISTINCT l_orderkey AS doc, p_brand AS topic FROM lineitem JOIN part ON l_partkey = p_partkey"


@register("topic_pmi", f"WITH {_pmi_sql(_BASKETS, 1, -9.0)} SELECT a, b, n_a, n_b, n_ab, round(pmi, 6) AS pmi FROM found")
def _(spark, d):
    """Brands that are ordered together."""
    lines = v.table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(v.table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return topics.cooccurrence(lines, "l_orderkey", "p_brand", 1, -9.0).withColumn("pmi", F.round("pmi", 6))


_WORDS = r"SELECT DISTINCT doc_id AS doc, unnest(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS topic FROM documents"
#: Documents that a pair of words shares at least, and its PMI.
_SHARED, _PMI = 8, 1.5


def words(spark: SparkSession, d: str) -> DataFrame:
    docs = v.table(spark, d, "documents")
    found = F.array_remove(F.array_distinct(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+")), "")
    return topics.lists_by(docs.select("doc_id", found.alias("topics")), "doc_id")


@register("word_pmi", f"WITH {_pmi_sql(_WORDS, _SHARED, _PMI)} SELECT a, b, n_a, n_b, n_ab, round(pmi, 6) AS pmi FROM found")
def _(spark, d):
    return topics.cooccurrence_of_lists(words(spark, d), _SHARED, _PMI).withColumn("pmi", F.floor(F.col("pmi") * 1e6 + 0.5) / 1e6)  # F.round goes by decimals, row by row


def _communities_sql(edges: str, rounds: int) -> str:
    """Label propagation, round by round."""
    steps = [f"""l{i + 1} AS MATERIALIZED (
  SELECT l.node, coalesce(x.label, l.community) AS community FROM l{i} l LEFT JOIN (
    SELECT node, arg_min(label, (-s, label <> community, label)) AS label FROM (
      SELECT e.node, t.community AS label, any_value(o.community) AS community, sum(weight) AS s FROM both_ends e JOIN l{i} t ON t.node = e.other JOIN l{i} o ON o.node = e.node
      WHERE (substr(md5(e.node), 1, 1) < '8') = {str(i % 2 == 0).lower()} GROUP BY 1, 2) GROUP BY 1) x ON x.node = l.node)""" for i in range(rounds)]  # fmt: skip
    return f"""{edges},
both_ends AS MATERIALIZED (SELECT a AS node, b AS other, n_ab AS weight FROM found UNION ALL SELECT b, a, n_ab FROM found),
l0 AS (SELECT DISTINCT node, node AS community FROM both_ends), {", ".join(steps)}
SELECT node, community FROM l{rounds}"""


@register("word_communities", "WITH " + _communities_sql(_pmi_sql(_WORDS, _SHARED, _PMI), 12))
def _(spark, d):
    """Words that belong together by the documents that share them."""
    return network.communities_of_topics(topics.held(words(spark, d), _SHARED, _PMI), 12)


_EXAMPLES_SQL = """SELECT query_id, CAST(rank AS INTEGER) AS rank, id, similarity FROM (
  SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(q.x, e.x), 6) AS similarity, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.x, e.x), 12) DESC, e.vec_id) AS rank
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings) q JOIN (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings) e ON q.vec_id % 20 = 0 AND {which}) WHERE rank <= 3"""


def _asked(e: DataFrame) -> DataFrame:
    return e.where("vec_id % 20 = 0")


@register("nearest_examples", _EXAMPLES_SQL.format(which="q.vec_id <> e.vec_id"))
def _(spark, d):
    """The three nearest examples, exactly, by an index of cells and their radii."""
    e = v.table(spark, d, "embeddings")
    found = neighbours.search(neighbours.build(e, "vec_id"), _asked(e), 3, "vec_id", exact=True)
    return found.withColumn("similarity", F.round("similarity", 6))


@register("nearest_past_examples", _EXAMPLES_SQL.format(which="e.vec_id < q.vec_id"))
def _(spark, d):
    """The same among what is older, vectors being numbered by time."""
    e = v.table(spark, d, "embeddings")
    found = neighbours.search(neighbours.build(e, "vec_id", at="vec_id"), _asked(e), 3, "vec_id", at="vec_id", exact=True)
    return found.withColumn("similarity", F.round("similarity", 6))


@register("nearest_recall", "SELECT count(*) AS queries, true AS recall_of_nine_tenths FROM embeddings WHERE vec_id % 20 = 0")
def _(spark, d):
    """Whether a search of as many cells as other queries need finds nine tenths of what the exact one finds."""
    e = v.table(spark, d, "embeddings")
    index = neighbours.build(e, "vec_id")
    probes = neighbours.calibrated(index, e.where("vec_id % 20 = 10"), 3, "vec_id")
    truth, found = (neighbours.search(index, _asked(e), 3, "vec_id", probes=probes, exact=exact) for exact in (True, False))
    return _asked(e).agg(F.count(F.lit(1)).alias("queries"), F.lit(neighbours.recall(found, truth) >= 0.9).alias("recall_of_nine_tenths"))


FEATURES = ["n", "mean", "breadth", "changes", "disagreement"]


def topic_weeks(spark: SparkSession, d: str) -> DataFrame:
    """Each topic's weeks with its signals, and whether it is in demand the week after: named more often than topics are on average."""
    found = mentions(spark, d)
    weekly = topics.signals(found, [*KEYS, "week"]).select(*KEYS, "week", "breadth", "changes", "disagreement")
    rows = topics.weekly_burst(found, KEYS).join(weekly, [*KEYS, "week"], "left").fillna(0, ["breadth", "changes", "disagreement"])
    rows = rows.withColumn("next", F.lead("n").over(Window.partitionBy(*KEYS).orderBy("week")))
    rows = written(rows.select(*KEYS, "week", *FEATURES, "next"), "topic-weeks")
    usual = rows.agg(F.avg("n")).first()[0]
    return rows.select(*KEYS, "week", *FEATURES, (F.col("next") > F.lit(usual)).cast("int").alias("picked")).where("picked IS NOT NULL")


def _ranking_sql() -> str:
    """Gradient steps on four weeks of five, scores of the fifth."""
    scaled = ", ".join(f"coalesce(({f} - avg({f}) FILTER (week % 5 <> 4) OVER ()) / coalesce(nullif(stddev_pop({f}) FILTER (week % 5 <> 4) OVER (), 0), 1), 0) AS x{i}" for i, f in enumerate(FEATURES))
    k = range(len(FEATURES))
    z = "b + " + " + ".join(f"w{i} * x{i}" for i in k)
    steps = [f"""w{r + 1}_ AS MATERIALIZED (SELECT any_value(b) + avg(e) AS b, {', '.join(f'any_value(w{i}) + avg(e * x{i}) - {ranking.PENALTY} * any_value(w{i}) AS w{i}' for i in k)}
  FROM (SELECT *, picked - 1 / (1 + exp(-({z}))) AS e FROM scaled, w{r}_ WHERE week % 5 <> 4))""" for r in range(ranking.ROUNDS)]  # fmt: skip
    return f"""WITH {MENTIONS_SQL},
counts AS (SELECT entity, theme, week, count(*) AS n FROM mentions GROUP BY ALL),
ends AS (SELECT min(week) AS first, max(week) AS last FROM counts),
dense AS (SELECT entity, theme, week, coalesce(n, 0) AS n FROM (SELECT entity, theme, unnest(range(min(week), (SELECT last FROM ends) + 1)) AS week FROM counts GROUP BY 1, 2) LEFT JOIN counts USING (entity, theme, week)),
m AS (SELECT *, lead(n) OVER (PARTITION BY entity, theme ORDER BY week) AS next, avg(n) OVER () AS usual,
             coalesce(sum(n) OVER (PARTITION BY entity, theme ORDER BY week RANGE BETWEEN 8 PRECEDING AND 1 PRECEDING), 0)::DOUBLE / nullif(least(8, week - (SELECT first FROM ends)), 0) AS mean FROM dense),
s AS (SELECT entity, theme, week, count(DISTINCT speaker) AS breadth, count(change) AS changes, count(*) FILTER (direction > 0) AS up, count(*) FILTER (direction < 0) AS down FROM mentions GROUP BY 1, 2, 3),
r AS (SELECT entity, theme, week, n, mean, coalesce(breadth, 0) AS breadth, coalesce(changes, 0) AS changes, coalesce(CASE WHEN greatest(up, down) > 0 THEN least(up, down) / greatest(up, down) ELSE 0.0 END, 0) AS disagreement, CAST(next > usual AS INT) AS picked
      FROM m LEFT JOIN s USING (entity, theme, week) WHERE next IS NOT NULL),
scaled AS MATERIALIZED (SELECT *, {scaled} FROM r),
w0_ AS (SELECT 0.0::DOUBLE AS b, {', '.join(f'0.0::DOUBLE AS w{i}' for i in k)}), {', '.join(steps)},
scored AS (SELECT entity, theme, week, picked, 1 / (1 + exp(-({z}))) AS score FROM scaled, w{ranking.ROUNDS}_ WHERE week % 5 = 4)"""


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    rows = topic_weeks(spark, d)
    model = ranking.fit(rows.where("week % 5 != 4"), FEATURES, "picked")
    return rows.where("week % 5 = 4").select(*KEYS, "week", "picked", model.score().alias("score"))


@register("topic_ranking", _ranking_sql() + " SELECT entity, theme, week, picked, round(score, 6) AS score FROM scored")
def _(spark, d):
    """Weeks that the fit has not seen, with the chance that the topic is in demand the week after."""
    return _ranked(spark, d).withColumn("score", F.round("score", 6))


@register("topic_ranking_judged", _ranking_sql() + """, h AS (SELECT picked, least(9999, floor(score * 10000)) AS step, count(*) AS c, sum(CASE WHEN picked = 1 THEN -ln(score) ELSE -ln(1 - score) END) AS loss FROM scored GROUP BY 1, 2)
SELECT CAST(sum(c) AS BIGINT) AS n, CAST(sum(c) FILTER (picked = 1) AS BIGINT) AS picked, round(sum(loss) / sum(c), 5) AS log_loss,
       (SELECT round(sum(y.c * n.c * CASE WHEN y.step > n.step THEN 1.0 WHEN y.step = n.step THEN 0.5 ELSE 0 END) / (sum(y.c * n.c)), 4) FROM h y JOIN h n ON y.picked = 1 AND n.picked = 0) AS auc FROM h""")
def _(spark, d):
    return ranking.judged(_ranked(spark, d), "picked").withColumns({"auc": F.round("auc", 4), "log_loss": F.round("log_loss", 5)})
