"""Outlier queries."""

from pyspark.sql import functions as F

from lumenframe.operators import outliers as O
from lumenframe.queries.profile import fence_sql
from lumenframe.queries.registry import query

HOLES = """WITH g AS (SELECT event_id, user_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events)
"""


def holes(t):
    return t.events.select("event_id", "user_id", F.expr("case when event_id % 7 = 0 then null else value end").alias("value"))


@query("out_zscore", HOLES + """SELECT g.* FROM g, (SELECT avg(user_id) mu, stddev_pop(user_id) su, avg(value) mv, stddev_pop(value) sv FROM g)
WHERE abs((user_id - mu) / su) < 3 AND abs((value - mv) / sv) < 3""")
def _(t):
    return O.zscore(holes(t), ["user_id", "value"])


@query("out_iqr", HOLES + f"""SELECT g.* FROM g, ({fence_sql('g', 'value')})
WHERE NOT coalesce(value < lo OR value > hi, false)""")
def _(t):
    return O.iqr(holes(t), ["user_id", "value"])


@query("out_null_mask", HOLES + f"""SELECT event_id, user_id, CASE WHEN value < lo OR value > hi THEN NULL ELSE value END AS value
FROM g, ({fence_sql('g', 'value')})""")
def _(t):
    return O.iqr(holes(t), ["user_id", "value"], mode="mask")


@query("out_isoforest")
def _(t):
    return O.isolation_forest(t.events.select("event_id", "user_id", "value"), "event_id", ["user_id", "value"])


@query("out_elliptic")
def _(t):
    return O.elliptic_envelope(t.lineitem.select("l_orderkey", "l_quantity", "l_extendedprice"), ["l_quantity", "l_extendedprice"])
