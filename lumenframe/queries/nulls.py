"""Null handling queries, on events with gaps put in by rule."""

from pyspark.sql import functions as F

from lumenframe.operators import nulls as N
from lumenframe.queries.registry import query, rounded, sr

GAPS = """WITH g AS (SELECT event_id, user_id, nullif(event_type, 'error') AS event_type,
 CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value,
 CASE WHEN event_id % 5 = 0 THEN NULL ELSE json_extract(props, '$.k')::double END AS k FROM events)
"""
ALL = ["event_id", "user_id", "event_type", "value", "k"]


def gaps(t):
    return t.events.select(
        "event_id",
        "user_id",
        F.expr("nullif(event_type, 'error')").alias("event_type"),
        F.expr("case when event_id % 7 = 0 then null else value end").alias("value"),
        F.expr("case when event_id % 5 = 0 then null else cast(get_json_object(props, '$.k') as double) end").alias("k"),
    )


TYPE_MODE = "coalesce(event_type, (SELECT event_type FROM g WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS event_type"


@query("null_drop_rows", GAPS + "SELECT * FROM g WHERE event_type IS NOT NULL AND value IS NOT NULL AND k IS NOT NULL")
def _(t):
    return N.drop_rows(gaps(t))


@query("null_drop_cols", GAPS + "SELECT event_id, user_id FROM g")
def _(t):
    return N.drop_null_columns(gaps(t))


@query("null_mean", GAPS + f"""SELECT event_id, user_id::double AS user_id, {TYPE_MODE},
 {sr('coalesce(value, (SELECT avg(value) FROM g))')} AS value, {sr('coalesce(k, (SELECT avg(k) FROM g))')} AS k FROM g""")
def _(t):
    return rounded(N.handle(gaps(t), N.MEAN, key="event_id"))


@query("null_median", GAPS + f"""SELECT event_id, user_id::double AS user_id, {TYPE_MODE},
 {sr('coalesce(value, (SELECT median(value) FROM g))')} AS value, {sr('coalesce(k, (SELECT median(k) FROM g))')} AS k FROM g""")
def _(t):
    return rounded(N.handle(gaps(t), N.MEDIAN, key="event_id"))


@query("null_mode", GAPS + f"""SELECT event_id, user_id, {TYPE_MODE},
 coalesce(value, (SELECT value FROM g WHERE value IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS value,
 coalesce(k, (SELECT k FROM g WHERE k IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS k FROM g""")
def _(t):
    return N.handle(gaps(t), N.MOST_FREQUENT, key="event_id")


@query("null_constant", GAPS + f"SELECT event_id, user_id, {TYPE_MODE}, coalesce(value, 0.0) AS value, coalesce(k, 0.0) AS k FROM g")
def _(t):
    return N.handle(gaps(t), N.CONSTANT, key="event_id")


def knn_sql():
    """Each missing cell against every row that holds the column, all rows of the table."""

    def near(c, a, b):
        return f"""{c}_n AS (SELECT q.event_id, d.{c} AS v, sqrt(
   (coalesce((q.{a} - d.{a}) * (q.{a} - d.{a}), 0.0) + coalesce((q.{b} - d.{b}) * (q.{b} - d.{b}), 0.0))
   * (2.0::double / nullif((q.{a} - d.{a} IS NOT NULL)::int + (q.{b} - d.{b} IS NOT NULL)::int, 0))) AS dist, d.event_id AS did
  FROM g q, g d WHERE q.{c} IS NULL AND d.{c} IS NOT NULL),
{c}_f AS (SELECT event_id, avg(v) AS v FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY dist, did) AS rn
  FROM {c}_n WHERE dist IS NOT NULL) WHERE rn <= 5 GROUP BY event_id)"""

    return GAPS.rstrip() + ", " + near("value", "user_id", "k") + ",\n" + near("k", "user_id", "value") + f"""
SELECT event_id, g.user_id, {sr('coalesce(g.value, vf.v)')} AS value, {sr('coalesce(g.k, kf.v)')} AS k
FROM g LEFT JOIN value_f vf USING (event_id) LEFT JOIN k_f kf USING (event_id)"""


@query("null_knn", knn_sql())
def _(t):
    cols = gaps(t).select("event_id", "user_id", "value", "k")
    return rounded(N.fill_knn(cols, "event_id", ["user_id", "value", "k"]))


@query("null_iterative")
def _(t):
    return rounded(N.fill_iterative(gaps(t), ["user_id", "value", "k"]))


@query("null_rules", GAPS + f"""SELECT event_id, user_id, event_type, {sr('coalesce(value, (SELECT avg(value) FROM g WHERE event_type IS NOT NULL))')} AS value,
 coalesce(k, 0.0) AS k FROM g WHERE event_type IS NOT NULL""")
def _(t):
    rules = [{"event_type": N.DROP_ROWS}, {"value": N.MEAN, "absent": N.MEAN}, {"k": N.CONSTANT}]
    return rounded(N.apply_rules(gaps(t), rules))
