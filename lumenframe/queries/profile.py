"""Profiling queries."""

from pyspark.sql import functions as F

from lumenframe.operators import profile as P
from lumenframe.queries.registry import query, r, rounded, sr, union_all

# Columns of the fixtures, with the type names Spark shows.
LINEITEM = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
    "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
    "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
}
LINE_NUMERIC = [c for c, t in LINEITEM.items() if t in ("bigint", "int", "double")]
EVENTS = {"event_id": "bigint", "user_id": "bigint", "event_type": "string", "value": "double"}
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

# Events with nulls put in by rule, as the fixtures hold none.
GAPPY = (
    "SELECT event_id, user_id, nullif(event_type, 'error') AS event_type, "
    "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events"
)


def gappy(t):
    return t.events.select(
        "event_id",
        "user_id",
        F.expr("nullif(event_type, 'error')").alias("event_type"),
        F.expr("case when event_id % 7 = 0 then null else value end").alias("value"),
    )


@query("prof_shape", """
SELECT count(*) AS n_rows, 11::bigint AS n_columns,
       'The table has ' || count(*) || ' rows and 11 columns.' AS summary FROM lineitem""")
def _(t):
    return P.shape(t.lineitem)


@query("prof_data_info", f"WITH g AS ({GAPPY})\n" + union_all(
    f"SELECT '{c}' AS \"column\", '{k}' AS dtype, count({c}) AS non_null, count(*) AS n_rows FROM g"
    for c, k in EVENTS.items()))
def _(t):
    return P.data_info(gappy(t))


@query("prof_column_info", f"WITH g AS ({GAPPY})\n" + union_all(
    f"SELECT '{c}' AS \"column\", count({c}) AS non_null, count(*) - count({c}) AS missing, "
    f"round(100.0::double * (count(*) - count({c})) / count(*), 2) AS missing_pct, "
    f"count(DISTINCT {c}) AS distinct_values, '{k}' AS dtype FROM g" for c, k in EVENTS.items()))
def _(t):
    return P.column_info(gappy(t))


@query("prof_dataset_info", f"""
WITH g AS ({GAPPY})
SELECT count(*) AS n_rows, 4::bigint AS n_columns, '{",".join(f"{c}:{k}" for c, k in EVENTS.items())}' AS column_types,
       bool_or(event_type IS NULL OR value IS NULL OR event_id IS NULL OR user_id IS NULL) AS has_missing FROM g""")
def _(t):
    return P.dataset_info(gappy(t))


@query("prof_validate", f"WITH g AS ({GAPPY})\n" + union_all(
    f"SELECT '{c}' AS \"column\", '{k}' AS dtype, count(*) - count({c}) AS nulls, count(*) AS n_rows, "
    f"true AS valid, NULL::varchar AS error FROM g" for c, k in EVENTS.items()))
def _(t):
    return P.validate(gappy(t), "value")


@query("prof_kind", union_all(
    f"SELECT '{c}' AS \"column\", "
    f"'{'integer' if k in ('bigint', 'int') else 'float' if k == 'double' else 'string'}' AS kind, "
    f"count({c}) AS n_values FROM lineitem" for c, k in LINEITEM.items() if c != "l_returnflag"))
def _(t):
    return P.column_kinds(t.lineitem, target="l_returnflag")


COUNTED = ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "l_discount"]


@query("prof_value_counts", union_all(
    f"SELECT '{c}' AS \"column\", {c}::varchar AS value, count(*) AS n FROM lineitem WHERE {c} IS NOT NULL GROUP BY {c}"
    for c in COUNTED))
def _(t):
    return P.value_counts(t.lineitem, COUNTED)


@query("prof_sample")
def _(t):
    return P.sample(t.lineitem, 30, seed=42)


@query("prof_sample_seeded", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5(concat(o_orderkey::varchar, '|42')) LIMIT 1000""")
def _(t):
    return P.sample_seeded(t.orders, "o_orderkey", 1000).select("o_orderkey", "o_totalprice")


@query("prof_head", "SELECT event_id, user_id, event_type, value FROM events ORDER BY event_id LIMIT 5")
def _(t):
    return P.head(t.events.select(*EVENTS), "event_id")


@query("prof_tail", "SELECT event_id, user_id, event_type, value FROM events ORDER BY event_id DESC LIMIT 5")
def _(t):
    return P.tail(t.events.select(*EVENTS), "event_id")


@query("prof_long_description")
def _(t):
    return P.long_description(t.orders, "o_orderkey")


def describe_sql(source, cols, places=4):
    """Long describe rows in SQL for the named columns."""
    stats = {
        "count": "count({c})", "mean": "avg({c})", "std": "stddev_samp({c})", "min": "min({c})",
        "q25": "quantile_cont({c}, 0.25)", "median": "quantile_cont({c}, 0.5)",
        "q75": "quantile_cont({c}, 0.75)", "max": "max({c})",
    }
    parts = []
    for c in cols:
        one = ", ".join(f"{e.format(c=c)}::double AS \"{s}\"" for s, e in stats.items())
        parts.append(
            f"SELECT '{c}' AS \"column\", stat, {sr('v', places)} AS value FROM "
            f"(SELECT {one} FROM {source}) UNPIVOT INCLUDE NULLS (v FOR stat IN ({', '.join(chr(34) + s + chr(34) for s in stats)}))"
        )
    return union_all(parts)


@query("prof_describe_num", describe_sql("lineitem", LINE_NUMERIC))
def _(t):
    return rounded(P.describe_numeric(t.lineitem), 4)


@query("prof_describe_cat", f"WITH g AS ({GAPPY})\n" + union_all(
    f"""SELECT '{c}' AS "column", (SELECT count({c}) FROM {s}) AS "count", (SELECT count(DISTINCT {c}) FROM {s}) AS "unique",
 {c} AS top, n AS freq FROM (SELECT {c}, count(*) AS n FROM {s} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY n DESC, {c} LIMIT 1)"""
    for s, c in (("g", "event_type"),)))
def _(t):
    return P.describe_categorical(gappy(t))


@query("prof_quality", f"WITH g AS ({GAPPY})\n" + union_all(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls, "
    f"count(*) - count(DISTINCT {c}) - CASE WHEN count({c}) < count(*) THEN 1 ELSE 0 END AS duplicates FROM g"
    for c in EVENTS))
def _(t):
    return P.quality(gappy(t))


@query("prof_quality_totals", f"WITH g AS ({GAPPY}), q AS (" + union_all(
    f"SELECT count(*) - count({c}) AS nulls, "
    f"count(*) - count(DISTINCT {c}) - CASE WHEN count({c}) < count(*) THEN 1 ELSE 0 END AS duplicates FROM g"
    for c in EVENTS) + ") SELECT sum(nulls)::bigint AS total_nulls, sum(duplicates)::bigint AS total_duplicates FROM q")
def _(t):
    return P.quality_totals(gappy(t))


def corr_sql(source, cols, places=6):
    pairs = [(a, b) for a in cols for b in cols]
    one = ", ".join(f"corr({a}, {b}) AS p{i}" for i, (a, b) in enumerate(pairs))
    rows = ", ".join(f"('{a}', '{b}', p{i})" for i, (a, b) in enumerate(pairs))
    return f"SELECT v.a AS \"row\", v.b AS col, {sr('v.c', places)} AS corr FROM (SELECT {one} FROM {source}) s, LATERAL (VALUES {rows}) v(a, b, c)"


@query("prof_corr", corr_sql("lineitem", LINE_NUMERIC))
def _(t):
    return rounded(P.correlation(t.lineitem))


@query("prof_corr_pivot", union_all(
    f"SELECT '{a}' AS \"row\", " + ", ".join(f"{sr(f'corr({a}, {b})')} AS {b}" for b in MEASURES) + " FROM lineitem"
    for a in MEASURES))
def _(t):
    return rounded(P.correlation_pivot(P.correlation(t.lineitem, MEASURES), MEASURES))


@query("prof_column_desc", """
WITH c AS (SELECT 'event_type=' || event_type AS "column", count(*) AS n FROM events GROUP BY event_type),
d AS (SELECT 'event_type=' || event_type AS "column", 'values from ' || min(value) || ' to ' || max(value) AS description
      FROM events WHERE event_type <> 'view' GROUP BY event_type)
SELECT c."column", c.n, d.description FROM c LEFT JOIN d USING ("column")""")
def _(t):
    name = F.concat(F.lit("event_type="), F.col("event_type")).alias("column")
    columns = t.events.groupBy(name).agg(F.count("*").alias("n"))
    text = F.concat(F.lit("values from "), F.min("value").cast("string"), F.lit(" to "), F.max("value").cast("string"))
    descriptions = t.events.where("event_type <> 'view'").groupBy(name).agg(text.alias("description"))
    return P.describe_columns(columns, descriptions)


@query("prof_skew_kurt", union_all(
    f"SELECT '{c}' AS \"column\", '{f}' AS stat, {sr(f'{f}({c})', 2)} AS value FROM lineitem"
    for c in LINE_NUMERIC for f in ("skewness", "kurtosis")))
def _(t):
    out = P.skew_kurtosis(t.lineitem)
    return out.select("column", "stat", r("value", 2).alias("value"))


TOPPED = {"part": ["p_name", "p_brand", "p_type"]}


@query("prof_top10", union_all(
    f"""SELECT '{c}' AS "column", value, n, rank FROM (SELECT {c} AS value, count(*) AS n,
 row_number() OVER (ORDER BY count(*) DESC, {c}) AS rank FROM part GROUP BY {c}) WHERE rank <= 10"""
    for c in TOPPED["part"]))
def _(t):
    return P.value_counts(t.part, TOPPED["part"], top_n=10)


def fence_sql(source, c, factor=1.5):
    """``lo`` and ``hi`` of the fence of one column."""
    q1, q3 = f"quantile_cont({c}, 0.25)", f"quantile_cont({c}, 0.75)"
    return f"SELECT {q1} - {factor} * ({q3} - {q1}) AS lo, {q3} + {factor} * ({q3} - {q1}) AS hi FROM {source}"


@query("prof_outlier_count", union_all(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} < lo OR {c} > hi) AS outliers "
    f"FROM {s}, ({fence_sql(s, c)})" for s, c in [("events", "event_id"), ("events", "user_id"), ("events", "value")]))
def _(t):
    return P.outlier_counts(t.events)


@query("prof_insights", f"""
WITH g AS (SELECT *, 1.0::double AS one FROM ({GAPPY})),
m AS ({union_all(f"SELECT '{c}' AS c, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS d FROM g" for c in [*EVENTS, "one"])}),
s AS ({union_all(f"SELECT '{c}' AS c, round(skewness({c}), 2) AS v FROM g" for c in ["event_id", "user_id", "value"])})
SELECT 'most_missing' AS insight, c AS "column", missing::double AS value FROM (SELECT * FROM m WHERE missing > 0 ORDER BY missing DESC, c DESC LIMIT 1)
UNION ALL SELECT 'constant', c, d::double FROM m WHERE d = 1
UNION ALL SELECT 'most_skewed', c, v FROM (SELECT * FROM s ORDER BY v DESC, c DESC LIMIT 1)
UNION ALL SELECT 'high_cardinality', c, d::double FROM m WHERE d > 50 AND c = 'event_type'""")
def _(t):
    return P.insights(gappy(t).withColumn("one", F.lit(1.0)))


@query("prof_json_safe", """
SELECT event_id, CASE WHEN event_id % 11 = 0 OR event_id % 13 = 0 THEN NULL ELSE value END AS value,
       strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts, CASE WHEN event_id % 11 = 0 OR event_id % 13 = 0 THEN NULL ELSE value END AS inner_value
FROM events""")
def _(t):
    wild = t.events.select(
        "event_id",
        F.expr("case when event_id % 11 = 0 then double('Infinity') when event_id % 13 = 0 then double('NaN') else value end")
        .alias("value"),
        "ts",
    )
    nested = wild.withColumn("nested", F.array(F.struct("value")))
    safe = P.json_safe(nested)
    return safe.select("event_id", "value", "ts", F.col("nested")[0]["value"].alias("inner_value"))
