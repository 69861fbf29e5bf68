"""Whole cleaning, statistics, chart and evaluation runs; user steps; status events."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from lumenframe.models import training as M
from lumenframe.operators import encode, nulls, outliers
from lumenframe.operators import joins as J
from lumenframe.operators import profile as P
from lumenframe.plans import clean as C
from lumenframe.plans import report as Y
from lumenframe.queries.nulls import GAPS, gaps
from lumenframe.queries.profile import corr_sql, describe_sql, fence_sql
from lumenframe.queries.registry import query, r, rounded, sr, union_all
from lumenframe.queries.training import classify, orders

CONFIG = C.CleaningConfig(
    target="k",
    key="event_id",
    column_nulls=[{"event_type": nulls.DROP_ROWS}],
    nulls=nulls.MEAN,
    outliers=outliers.IQR,
    encoder=encode.LABEL,
    normalization="L2 Normalization",
    scaling="Min-Max Scaler",
)

FILLED = ["user_id", "value", "k"]


def scaled_sql(cols, form, source):
    return ", ".join(f"{sr(form.format(c=c))} AS {c}" for c in cols)


L2 = ["user_id", "event_type", "value"]


@query("pipe_clean", GAPS.rstrip() + f""",
a AS (SELECT * FROM g WHERE event_type IS NOT NULL),
b AS (SELECT event_id, coalesce(user_id, (SELECT avg(user_id) FROM a))::double AS user_id, event_type,
 coalesce(value, (SELECT avg(value) FROM a)) AS value, coalesce(k, (SELECT avg(k) FROM a)) AS k FROM a),
c AS (SELECT b.* FROM b, {", ".join(f"({fence_sql('b', x)}) f_{x}" for x in FILLED)}
 WHERE {" AND ".join(f"{x} >= f_{x}.lo AND {x} <= f_{x}.hi" for x in FILLED)}),
d AS (SELECT event_id, user_id, (dense_rank() OVER (ORDER BY event_type) - 1)::double AS event_type, value, k FROM c),
n AS (SELECT event_id, {", ".join(f"{x} / CASE WHEN s = 0 THEN 1 ELSE s END AS {x}" for x in L2)}, k
 FROM (SELECT *, sqrt(user_id * user_id + event_type * event_type + value * value) AS s FROM d))
SELECT event_id, {", ".join(sr(f"({x} - min({x}) OVER ()) / (max({x}) OVER () - min({x}) OVER ())") + f" AS {x}" for x in L2)}, {sr('k')} AS k FROM n""")
def _(t):
    return rounded(C.clean(gaps(t), CONFIG))


@query("pipe_clean_default", GAPS.rstrip() + f""",
a AS (SELECT event_id, user_id::double AS user_id, coalesce(event_type, '0') AS event_type, coalesce(value, 0.0) AS value, coalesce(k, 0.0) AS k FROM g),
d AS (SELECT event_id, user_id, (dense_rank() OVER (ORDER BY event_type) - 1)::double AS event_type, value, k FROM a),
n AS (SELECT event_id, {", ".join(f"{x} / CASE WHEN s = 0 THEN 1 ELSE s END AS {x}" for x in L2)}, k
 FROM (SELECT *, sqrt(user_id * user_id + event_type * event_type + value * value) AS s FROM d))
SELECT event_id, {", ".join(sr(f"({x} - avg({x}) OVER ()) / stddev_pop({x}) OVER ()") + f" AS {x}" for x in L2)}, {sr('k')} AS k FROM n""")
def _(t):
    chosen = C.from_choices({"key": "event_id", "target": "k", "nulls": "No Such Handler", "scaling": "Standard Scaler"})
    return rounded(C.clean(gaps(t), chosen))


STAT_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
KEPT = f"""k AS (SELECT l.* FROM lineitem l, {", ".join(f"({fence_sql('lineitem', x)}) f_{x}" for x in STAT_COLS)}
 WHERE {" AND ".join(f"{x} >= f_{x}.lo AND {x} <= f_{x}.hi" for x in STAT_COLS)}),
m AS (SELECT l_returnflag, {", ".join(f"CASE WHEN {x} >= f_{x}.lo AND {x} <= f_{x}.hi THEN {x} END AS {x}" for x in STAT_COLS)}
 FROM lineitem, {", ".join(f"({fence_sql('lineitem', x)}) f_{x}" for x in STAT_COLS)})"""
NOTES = {c: f"measure {c}" for c in STAT_COLS[:2]}


@query("pipe_stats", f"""
WITH {KEPT}, d AS ({describe_sql('k', STAT_COLS)}), c AS ({corr_sql('k', STAT_COLS, 4)}),
q AS ({union_all(f"SELECT '{x}' AS item, count(*) - count({x}) AS nulls, count(*) - count(DISTINCT {x}) - CASE WHEN count({x}) < count(*) THEN 1 ELSE 0 END AS duplicates FROM m" for x in ["l_returnflag", *STAT_COLS])})
SELECT 'describe' AS section, "column" AS item, stat, value, NULL::varchar AS text FROM d
UNION ALL SELECT 'correlation', "row", col, corr, NULL FROM c
UNION ALL SELECT 'quality', item, 'nulls', nulls::double, NULL FROM q
UNION ALL SELECT 'quality', item, 'duplicates', duplicates::double, NULL FROM q
UNION ALL SELECT 'description', c, 'text', NULL, CASE c {" ".join(f"WHEN '{c}' THEN '{n}'" for c, n in NOTES.items())} END
 FROM (VALUES {", ".join(f"('{c}')" for c in ["l_returnflag", *STAT_COLS])}) v(c)""")
def _(t):
    """Filter outliers of the line items, then describe what is left."""
    lines = t.lineitem.select("l_returnflag", *STAT_COLS)
    notes = t.spark.createDataFrame(list(NOTES.items()), "column string, description string")
    out = Y.statistics(lines, C.CleaningConfig(outliers=outliers.IQR), notes)
    return out.withColumn("value", r("value", 4))


@query("pipe_auto_charts")
def _(t):
    return rounded(Y.automatic_charts(t.orders.select("o_orderstatus", "o_orderpriority", "o_totalprice", "o_custkey")))


@query("pipe_inspect")
def _(t):
    return rounded(Y.inspect(t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice", "o_custkey"), "o_orderkey"))


@query("pipe_evaluate")
def _(t):
    """Save a model, load it, score the table, and report metrics and importances."""
    from lumenframe.session import scratch_path

    config = classify("Random Forest Classifier", n_estimators=10, max_depth=5)
    result = M.train(orders(t), config)
    path = scratch_path(t.spark, "model")
    M.save(result.prepare, result.model, path)
    scored = M.predict_batch(orders(t), path, config)
    labels = result.prepare.stages[-1].transform(scored)
    metrics = M.metric_rows(t.spark, "evaluation", M.score(labels, "classification")).select("metric", "value")
    return Y.metric_lines(metrics, M.feature_importance(result))


USER_SQL = "SELECT o_orderpriority, o_orderstatus, count(*) AS n, max(o_totalprice) AS top FROM df GROUP BY o_orderpriority, o_orderstatus"
USER_TYPES = {"o_orderpriority": "string", "o_orderstatus": "string", "n": "bigint", "top": "double"}


@query("udf_user_transform", f"WITH df AS (SELECT * FROM orders), u AS ({USER_SQL})\n" + union_all(
    f"SELECT '{c}' AS \"column\", count({c}) AS non_null, count(*) - count({c}) AS missing, round(100.0::double * (count(*) - count({c})) / count(*), 2) AS missing_pct, "
    f"count(DISTINCT {c}) AS distinct_values, '{k}' AS dtype FROM u" for c, k in USER_TYPES.items()))
def _(t):
    return P.column_info(Y.apply_user(t.orders, USER_SQL))


@query("udf_custom_handler", "SELECT event_id, least(greatest(value, 1.0), 20.0) AS value FROM events WHERE user_id <> 3")
def _(t):
    """A table step and a batch step of the user, chained."""

    def clip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(value=b["value"].clip(1.0, 20.0))

    kept = t.events.transform(lambda d: d.where("user_id <> 3")).select("event_id", "value")
    return Y.apply_user(kept, lambda d: d.mapInPandas(clip, "event_id long, value double"))


@query("evt_status_apply", """
SELECT user_id, arg_max(event_type, event_id) FILTER (WHERE event_type <> 'view') AS status, arg_max(value, event_id) FILTER (WHERE value > 5) AS seconds,
 count(*) AS n_events FROM events GROUP BY user_id""")
def _(t):
    changes = t.events.select("user_id", "event_id", F.expr("nullif(event_type, 'view')").alias("status"), F.expr("case when value > 5 then value end").alias("seconds"))
    return J.latest_events(changes, "user_id", ["event_id"], ["status", "seconds"])
