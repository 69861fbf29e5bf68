"""Aggregation and chart data queries."""

from pyspark.sql import functions as F

from lumenframe.operators import charts as C
from lumenframe.operators import profile as P
from lumenframe.operators.select import components
from lumenframe.queries.profile import MEASURES, corr_sql
from lumenframe.queries.registry import query, r, rounded, sr, union_all


@query("agg_stats", union_all(
    f"""SELECT '{c}' AS "column", count({c}) AS n, {sr(f'sum({c})', 2)} AS total, {sr(f'avg({c})')} AS mean,
 {sr(f'stddev_samp({c})')} AS std, min({c}) AS low, max({c}) AS high FROM lineitem""" for c in MEASURES))
def _(t):
    row = t.lineitem.agg(*[
        F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), r(F.sum(c), 2).alias("total"), r(F.avg(c)).alias("mean"),
                 r(F.stddev_samp(c)).alias("std"), F.min(c).alias("low"), F.max(c).alias("high")).alias(c) for c in MEASURES])
    return row.select(F.inline(F.array(*MEASURES)))


@query("agg_group_count", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
def _(t):
    return C.count_plot(t.lineitem, "l_returnflag", ["l_linestatus"])


@query("agg_distinct", union_all(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n FROM part" for c in ("p_name", "p_brand", "p_type", "p_size", "p_retailprice")))
def _(t):
    cols = ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
    return P.frequencies(t.part, cols).groupBy("column").agg(F.count("value").alias("n"))


@query("agg_quantile", f"""
SELECT l_returnflag, {sr('quantile_cont(l_extendedprice, 0.25)')} AS q25, {sr('quantile_cont(l_extendedprice, 0.75)')} AS q75
FROM lineitem GROUP BY l_returnflag""")
def _(t):
    q = C.grouped_quantiles(t.lineitem, ["l_returnflag"], "l_extendedprice", (0.25, 0.75))
    return q.select("l_returnflag", r(F.col("q")[0]).alias("q25"), r(F.col("q")[1]).alias("q75"))


@query("agg_hist_group", f"""
WITH s AS (SELECT min(value) AS lo, (max(value) - min(value)) / 20 AS w FROM events)
SELECT least(floor((value - lo) / w), 19)::bigint AS bin, event_type, count(*) AS n,
 {sr('any_value(lo) + least(floor((value - lo) / w), 19) * any_value(w)')} AS bin_start
FROM events, s GROUP BY least(floor((value - lo) / w), 19), event_type""")
def _(t):
    return rounded(C.histogram(t.events, "value", 20, ["event_type"]))


@query("agg_count_plot", "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")
def _(t):
    return C.count_plot(t.orders, "o_orderpriority", ["o_orderstatus"])


@query("agg_bar", f"SELECT o_orderpriority, o_orderstatus, {sr('sum(o_totalprice)', 2)} AS total FROM orders GROUP BY 1, 2")
def _(t):
    return rounded(C.bar(t.orders, "o_orderpriority", "o_totalprice", ["o_orderstatus"]), 2)


@query("agg_pie", f"""
WITH s AS (SELECT p_brand, count(*) AS n, sum(p_retailprice) AS size FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 15)
SELECT p_brand, n, {sr('size', 4)} AS size, {sr('size / sum(size) OVER ()')} AS share FROM s""")
def _(t):
    out = C.pie(t.part, "p_brand", "p_retailprice")
    return out.select("p_brand", "n", r("size", 4).alias("size"), r("share").alias("share"))


@query("agg_treemap", f"""
SELECT p_type, p_brand, {sr('sum(p_retailprice)', 4)} AS total, count(*) AS n,
 (2 - grouping(p_type) - grouping(p_brand))::bigint AS level FROM part GROUP BY ROLLUP (p_type, p_brand)""")
def _(t):
    return rounded(C.treemap(t.part, ["p_type", "p_brand"], "p_retailprice"), 4)


@query("agg_radar", f"SELECT event_type, (user_id % 3) AS team, {sr('avg(value)')} AS mean FROM events GROUP BY ALL")
def _(t):
    return rounded(C.radar(t.events.withColumn("team", F.col("user_id") % 3), "value", "event_type", ["team"]))


def box_sql(source, key, y):
    return f"""SELECT {key}, {sr('any_value(q[1])')} AS q1, {sr('any_value(q[2])')} AS median, {sr('any_value(q[3])')} AS q3,
 min({y}) FILTER (WHERE {y} BETWEEN q[1] - 1.5 * (q[3] - q[1]) AND q[3] + 1.5 * (q[3] - q[1])) AS lower,
 max({y}) FILTER (WHERE {y} BETWEEN q[1] - 1.5 * (q[3] - q[1]) AND q[3] + 1.5 * (q[3] - q[1])) AS upper,
 count(*) FILTER (WHERE NOT {y} BETWEEN q[1] - 1.5 * (q[3] - q[1]) AND q[3] + 1.5 * (q[3] - q[1])) AS outliers
FROM {source} JOIN (SELECT {key}, quantile_cont({y}, [0.25, 0.5, 0.75]) AS q FROM {source} GROUP BY {key}) USING ({key}) GROUP BY {key}"""


@query("agg_box", box_sql("events", "event_type", "value"))
def _(t):
    return rounded(C.box(t.events, "value", ["event_type"]))


def kde_sql(source, x, points=100, bins=1024):
    return f"""s AS (SELECT count({x}) AS n, stddev_samp({x}) * pow(count({x}), -0.2::double) AS h, min({x}) AS lo, max({x}) AS hi,
   (max({x}) - min({x})) / {bins} AS step FROM {source}),
b AS (SELECT any_value(lo) + (least(floor(({x} - lo) / step), {bins - 1}) + 0.5::double) * any_value(step) AS c, count(*) AS w
      FROM {source}, s GROUP BY least(floor(({x} - lo) / step), {bins - 1})),
k AS (SELECT i AS point, any_value(lo + i * (hi - lo) / {points - 1}) AS x,
   sum(w * exp(-0.5::double * ((lo + i * ((hi - lo) / {points - 1}) - c) / h) * ((lo + i * ((hi - lo) / {points - 1}) - c) / h)))
   / any_value(n * h * 2.5066282746310002::double) AS density
 FROM b, s, range({points}) r(i) GROUP BY i)"""


@query("agg_kde", f"WITH {kde_sql('events', 'value')} SELECT point, {sr('x')} AS x, {sr('density', 9)} AS density FROM k")
def _(t):
    d = C.density(t.events, "value")
    return d.select("point", r("x").alias("x"), r("density", 9).alias("density"))


@query("agg_violin", f"""WITH {kde_sql('orders', 'o_totalprice')}, o AS (SELECT 1 AS one, o_totalprice FROM orders),
x AS ({box_sql('o', 'one', 'o_totalprice')})
SELECT point, {sr('x', 4)} AS x, {sr('density', 12)} AS density, q1, median, q3, lower, upper, outliers FROM k, x""")
def _(t):
    v = C.violin(t.orders, "o_totalprice")
    return v.select("point", r("x", 4).alias("x"), r("density", 12).alias("density"), r("q1").alias("q1"),
                    r("median").alias("median"), r("q3").alias("q3"), "lower", "upper", "outliers")


@query("agg_heatmap", corr_sql("lineitem", MEASURES))
def _(t):
    return rounded(P.correlation(t.lineitem, MEASURES))


@query("pts_scatter", """
SELECT o_totalprice AS x, o_custkey AS y, o_orderstatus AS color FROM orders ORDER BY md5(concat(o_orderkey::varchar, '|42')) LIMIT 1000""")
def _(t):
    named = t.orders.select("o_orderkey", F.col("o_totalprice").alias("x"), F.col("o_custkey").alias("y"), F.col("o_orderstatus").alias("color"))
    return C.scatter(named, ["x", "y", "color"], "o_orderkey", 1000)


PAIRED = [("p_size", "p_retailprice"), ("p_size", "p_partkey"), ("p_retailprice", "p_partkey")]


@query("pts_pair", union_all(
    f"SELECT p_partkey, '{a}' AS x_col, '{b}' AS y_col, {a}::double AS x, {b}::double AS y FROM part" for a, b in PAIRED))
def _(t):
    return C.pair_points(t.part, "p_partkey", ["p_size", "p_retailprice", "p_partkey"])


@query("pts_cluster")
def _(t):
    points = components(t.embeddings, "embedding").select(
        F.lit("point").alias("kind"), "label", F.col("vec_id").alias("point_key"), "pc1", "pc2")
    centres = points.groupBy("label").agg(F.avg("pc1").alias("pc1"), F.avg("pc2").alias("pc2"))
    return rounded(points.unionByName(centres.select(
        F.lit("centroid").alias("kind"), "label", F.lit(None).cast("long").alias("point_key"), "pc1", "pc2")))


@query("agg_mode_class", """
WITH c AS (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1)
SELECT count(*) AS classes, count(*) = 1 AS single_class, max(n) AS majority_rows,
 (SELECT l_returnflag FROM c ORDER BY n DESC, l_returnflag DESC LIMIT 1) AS majority FROM c""")
def _(t):
    counts = t.lineitem.groupBy("l_returnflag").agg(F.count("*").alias("n"))
    return counts.agg(F.count("*").alias("classes"), (F.count("*") == 1).alias("single_class"), F.max("n").alias("majority_rows"),
                      F.max_by("l_returnflag", F.struct("n", "l_returnflag")).alias("majority"))


RUNS = "count(*) AS runs, {} AS mean, {} AS std, min(value) AS low, max(value) AS high".format(sr("avg(value)"), sr("stddev_pop(value)"))


@query("agg_run_stats", f"SELECT {RUNS} FROM events")
def _(t):
    return t.events.agg(F.count("*").alias("runs"), r(F.avg("value")).alias("mean"), r(F.stddev_pop("value")).alias("std"),
                        F.min("value").alias("low"), F.max("value").alias("high"))


@query("agg_perf_log", f"SELECT event_type AS function_name, count(DISTINCT user_id) AS users, {RUNS} FROM events GROUP BY event_type")
def _(t):
    log = t.events.select(F.col("event_type").alias("function_name"), "value", "user_id", "ts")
    return log.groupBy("function_name").agg(
        F.count_distinct("user_id").alias("users"), F.count("*").alias("runs"), r(F.avg("value")).alias("mean"),
        r(F.stddev_pop("value")).alias("std"), F.min("value").alias("low"), F.max("value").alias("high"))
