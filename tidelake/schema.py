"""Fixed schemas of the observation store."""

from pyspark.sql import types as T

DIM_FIELDS = ("metric", "entity", "region", "period", "source")
REQUIRED_COLUMNS = ("dataset", "metric", "entity", "period", "value")
#: Most rows and cells an interactive query may return.
ROW_CAP, CELL_CAP = 5000, 20000

_S, _L = T.StringType(), T.LongType()
OBSERVATIONS = T.StructType(
    [T.StructField(c, _L) for c in ("load_id", "seq")] + [T.StructField(c, _S) for c in ("dataset", "metric", "entity", "region", "period", "period_sort", "source")] + [T.StructField("value", T.DoubleType()), T.StructField("unit", _S)]
)
LOADS = T.StructType([T.StructField("id", _L), *(T.StructField(c, _S) for c in ("dataset", "content_hash")), T.StructField("rows", _L), *(T.StructField(c, _S) for c in ("status", "error", "started_at", "finished_at", "version_label", "version_sort"))])
REPORTS = T.StructType([T.StructField("load_id", _L), T.StructField("report", _S)])
DATASETS = T.StructType([T.StructField(c, _S) for c in ("name", "title", "updated_at")])
