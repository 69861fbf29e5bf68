"""Window, sort and top-k queries."""

from pyspark.sql import functions as F

from lumenframe.functions.ordering import seeded_rank
from lumenframe.functions.stats import top_by
from lumenframe.metrics import classification as M
from lumenframe.metrics.compare import best
from lumenframe.operators import charts as C
from lumenframe.operators import profile as P
from lumenframe.queries.profile import GAPPY, LINE_NUMERIC, gappy
from lumenframe.queries.registry import query, r, rounded, sr, union_all


@query("win_latest_per_key", """
SELECT o_custkey, o_orderkey, o_orderstatus FROM
 (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def _(t):
    return t.orders.groupBy("o_custkey").agg(
        F.max("o_orderkey").alias("o_orderkey"), F.max_by("o_orderstatus", "o_orderkey").alias("o_orderstatus"))


@query("win_topn_per_group", """
SELECT o_custkey, o_orderkey, o_totalprice, rank FROM
 (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3""")
def _(t):
    return top_by(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"],
                  [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()], 3)


RANKED = [c for c in LINE_NUMERIC if c != "l_extendedprice"]


@query("win_rank_sort", f"""
WITH c AS ({union_all(f"SELECT '{c}' AS feature, round(abs(corr({c}, l_extendedprice)), 6) AS importance FROM lineitem" for c in RANKED)})
SELECT feature, importance, row_number() OVER (ORDER BY importance DESC, feature) AS rank FROM c""")
def _(t):
    from lumenframe.models.importance import ranked

    row = t.lineitem.agg(*[r(F.abs(F.corr(c, "l_extendedprice"))).alias(c) for c in RANKED])
    cells = [F.struct(F.lit(c).alias("feature"), F.col(c).alias("importance")) for c in RANKED]
    return ranked(row.select(F.inline(F.array(*cells))))


@query("win_cum_roc", """
WITH c AS (SELECT l_discount AS score, count(*) FILTER (WHERE l_returnflag = 'R') AS pos, count(*) FILTER (WHERE l_returnflag <> 'R') AS neg
 FROM lineitem GROUP BY 1)
SELECT score, pos, neg, (sum(pos) OVER w)::bigint AS cum_pos, (sum(neg) OVER w)::bigint AS cum_neg FROM c
WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)""")
def _(t):
    return M.threshold_counts(t.lineitem, "l_discount", F.col("l_returnflag") == "R")


@query("win_share", f"""
WITH s AS (SELECT o_orderpriority, o_orderstatus, sum(o_totalprice) AS total FROM orders GROUP BY 1, 2)
SELECT o_orderpriority, o_orderstatus, {sr('total', 2)} AS total, {sr('total / sum(total) OVER (PARTITION BY o_orderpriority)')} AS share FROM s""")
def _(t):
    out = C.group_share(t.orders, ["o_orderpriority"], ["o_orderstatus"], "o_totalprice")
    return out.select("o_orderpriority", "o_orderstatus", r("total", 2).alias("total"), r("share").alias("share"))


@query("win_line_series", f"""
SELECT strftime(date_trunc('month', l_shipdate), '%Y-%m-%d %H:%M:%S') AS step, l_returnflag, {sr('sum(l_quantity)', 2)} AS total, count(*) AS n
FROM lineitem GROUP BY 1, 2""")
def _(t):
    return rounded(C.series(t.lineitem, "l_shipdate", "month", "l_quantity", ["l_returnflag"]), 2)


@query("win_stratify", """
SELECT o_orderkey, o_orderstatus,
 row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(concat(o_orderkey::varchar, '|42'))) AS rank FROM orders""")
def _(t):
    return seeded_rank(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderkey", 42, "o_orderstatus")


@query("sort_desc_history", "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey")
def _(t):
    return t.orders.select("o_orderkey", "o_orderdate", "o_totalprice").orderBy(F.col("o_orderdate").desc(), "o_orderkey")


@query("topk_recent5", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 5")
def _(t):
    return t.orders.select("o_orderkey", "o_orderdate").orderBy(F.col("o_orderdate").desc(), "o_orderkey").limit(5)


@query("topk_logs100", "SELECT event_id, event_type, value FROM events ORDER BY ts DESC, event_id LIMIT 100")
def _(t):
    return t.events.orderBy(F.col("ts").desc(), "event_id").limit(100).select("event_id", "event_type", "value")


RESULTS = f"""SELECT event_type AS model, 'mae' AS metric, {sr('avg(value)')} AS value FROM events GROUP BY 1
UNION ALL SELECT event_type, 'rmse', {sr('sqrt(avg(value * value))')} FROM events GROUP BY 1
UNION ALL SELECT event_type, 'accuracy', {sr('avg((value > 10)::int)')} FROM events GROUP BY 1"""


def run_results(t):
    """Runs of four models with three metrics each."""
    row = t.events.groupBy(F.col("event_type").alias("model")).agg(
        r(F.avg("value")).alias("mae"), r(F.sqrt(F.avg(F.col("value") * F.col("value")))).alias("rmse"),
        r(F.avg((F.col("value") > 10).cast("int"))).alias("accuracy"))
    return row.unpivot("model", ["mae", "rmse", "accuracy"], "metric", "value")


@query("topk_best_model", f"""
WITH x AS ({RESULTS})
SELECT metric, model, value FROM (SELECT *, row_number() OVER (PARTITION BY metric
 ORDER BY CASE WHEN metric IN ('mae', 'rmse') THEN value ELSE -value END, model) AS rn FROM x) WHERE rn = 1""")
def _(t):
    return best(run_results(t))


@query("topk_most_missing", f"""
WITH g AS ({GAPPY}), m AS ({union_all(f"SELECT '{c}' AS c, count(*) - count({c}) AS n FROM g" for c in ("event_id", "user_id", "event_type", "value"))})
SELECT c AS "column", n AS missing FROM m ORDER BY n DESC, c DESC LIMIT 1""")
def _(t):
    return P.column_info(gappy(t)).agg(
        F.max_by("column", F.struct("missing", "column")).alias("column"), F.max("missing").alias("missing"))
