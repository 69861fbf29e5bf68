"""Metric queries on predictions built by rule."""

from pyspark.sql import functions as F

from lumenframe.metrics import classification as M
from lumenframe.metrics import clustering as K
from lumenframe.metrics import regression as R
from lumenframe.metrics.compare import long, wide
from lumenframe.queries.registry import query, r, rounded, sr, union_all
from lumenframe.queries.windows import RESULTS, run_results

# Truth: the return flag. Prediction: by quantity, one class never predicted.
PRED = """WITH x AS (SELECT l_returnflag AS truth, CASE WHEN l_quantity > 30 THEN 'R' WHEN l_quantity > 5 THEN 'A' ELSE 'X' END AS predicted FROM lineitem),
c AS (SELECT truth, predicted, count(*) AS n FROM x GROUP BY 1, 2),
l AS (SELECT truth AS label FROM c UNION SELECT predicted FROM c),
m AS (SELECT label, coalesce((SELECT sum(n) FROM c WHERE truth = label AND predicted = label), 0) AS hit,
 coalesce((SELECT sum(n) FROM c WHERE truth = label), 0) AS support, coalesce((SELECT sum(n) FROM c WHERE predicted = label), 0) AS given FROM l),
s AS (SELECT label, support, hit, CASE WHEN given = 0 THEN 0.0 ELSE hit / given END AS precision, CASE WHEN support = 0 THEN 0.0 ELSE hit / support END AS recall FROM m),
f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2.0 * precision * recall / (precision + recall) END AS f1 FROM s)
"""


def predictions(t):
    guess = F.when(F.col("l_quantity") > 30, "R").when(F.col("l_quantity") > 5, "A").otherwise("X")
    return t.lineitem.select(F.col("l_returnflag").alias("truth"), guess.alias("predicted"))


for _name, _col, _sql in (
    ("met_accuracy", "accuracy", "sum(hit) / sum(support)"),
    ("met_precision_w", "precision", "sum(precision * support) / sum(support)"),
    ("met_recall_w", "recall", "sum(recall * support) / sum(support)"),
    ("met_f1_w", "f1", "sum(f1 * support) / sum(support)"),
):

    @query(_name, PRED + f"SELECT {sr(_sql)} AS \"{_col}\" FROM f")
    def _(t, _col=_col):
        return rounded(M.weighted(predictions(t), "truth", "predicted").select(_col))


@query("met_confusion", PRED + """SELECT a.label AS truth, b.label AS predicted, coalesce(n, 0) AS n
FROM l a CROSS JOIN l b LEFT JOIN c ON c.truth = a.label AND c.predicted = b.label""")
def _(t):
    return M.confusion(predictions(t), "truth", "predicted")


@query("met_class_report", PRED + "SELECT * FROM (" + union_all([
    f"SELECT label, {sr('precision')} AS precision, {sr('recall')} AS recall, {sr('f1')} AS f1, support::bigint AS support FROM f",
    f"SELECT 'accuracy', {sr('sum(hit) / sum(support)')}, {sr('sum(hit) / sum(support)')}, {sr('sum(hit) / sum(support)')}, sum(support)::bigint FROM f",
    f"SELECT 'macro avg', {sr('avg(precision)')}, {sr('avg(recall)')}, {sr('avg(f1)')}, sum(support)::bigint FROM f",
    "SELECT 'weighted avg', " + ", ".join(sr(f"sum({m} * support) / sum(support)") for m in ("precision", "recall", "f1")) + ", sum(support)::bigint FROM f",
]) + ")")
def _(t):
    return rounded(M.report(predictions(t), "truth", "predicted"))


# Score: price per size, nearly unique. Truth: high discount.
SCORED = """WITH c AS (SELECT l_extendedprice AS score, count(*) FILTER (WHERE l_discount > 0.05) AS pos,
 count(*) FILTER (WHERE l_discount <= 0.05) AS neg FROM lineitem GROUP BY 1),
w AS (SELECT *, sum(pos) OVER o AS tp, sum(neg) OVER o AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM c
 WINDOW o AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
"""


def scored(t):
    return t.lineitem.select("l_extendedprice", "l_discount"), "l_extendedprice", F.col("l_discount") > 0.05


@query("met_roc", SCORED + f"""SELECT score AS threshold, {sr('fp / n')} AS fpr, {sr('tp / p')} AS tpr FROM w
UNION ALL SELECT NULL, 0.0, 0.0""")
def _(t):
    return rounded(M.roc(*scored(t)))


@query("met_auc", SCORED + f"SELECT {sr('sum(neg * (2.0 * tp - pos) / 2.0) / any_value(p * n)')} AS auc FROM w")
def _(t):
    return rounded(M.auc(*scored(t)))


@query("met_auc_ovr", f"""
WITH x AS ({union_all(f"SELECT '{c}' AS class, {s} AS score, l_returnflag = '{c}' AS hit FROM lineitem" for c, s in (('A', 'l_discount'), ('N', 'l_tax'), ('R', 'l_extendedprice')))}),
c AS (SELECT class, score, count(*) FILTER (WHERE hit) AS pos, count(*) FILTER (WHERE NOT hit) AS neg FROM x GROUP BY 1, 2),
w AS (SELECT *, sum(pos) OVER (PARTITION BY class ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp FROM c),
a AS (SELECT class, sum(pos) AS p, sum(neg * (2.0::double * tp - pos) / 2.0::double) / (sum(pos)::double * sum(neg)) AS auc FROM w GROUP BY 1)
SELECT {sr('sum(auc * p) / sum(p)')} AS auc FROM a""")
def _(t):
    return rounded(M.auc_one_vs_rest(t.lineitem, "l_returnflag", {"A": "l_discount", "N": "l_tax", "R": "l_extendedprice"}))


@query("met_pr", SCORED + f"""SELECT score AS threshold, {sr('tp / (tp + fp)')} AS precision, {sr('tp / p')} AS recall FROM w
UNION ALL SELECT NULL, 1.0, 0.0""")
def _(t):
    return rounded(M.precision_recall(*scored(t)))


@query("met_ap", SCORED + f"SELECT {sr('sum(pos::double * tp / (tp + fp)) / any_value(p)')} AS average_precision FROM w")
def _(t):
    return rounded(M.average_precision(*scored(t)))


# Regression: the price is guessed from the quantity.
FIT = "SELECT l_orderkey, l_linenumber, l_extendedprice AS y, l_quantity * 1000 AS p FROM lineitem"


def fitted(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1000).alias("p"))


for _name, _col, _sql, _places in (
    ("met_mae", "mae", "avg(abs(y - p))", 4),
    ("met_mse", "mse", "avg((y - p) * (y - p))", 1),
    ("met_rmse", "rmse", "sqrt(avg((y - p) * (y - p)))", 4),
    ("met_r2", "r2", "1.0::double - sum((y - p) * (y - p)) / (count(*) * var_pop(y))", 6),
    ("met_mape", "mape", "avg(abs(y - p) / greatest(abs(y), 2.220446049250313e-16))", 6),
):

    @query(_name, f"SELECT {sr(_sql, _places)} AS {_col} FROM ({FIT})")
    def _(t, _col=_col, _places=_places):
        return rounded(R.all_metrics(fitted(t), "y", "p").select(_col), _places)


@query("met_residuals", f"SELECT l_orderkey, l_linenumber, y AS actual, p AS predicted, {sr('y - p')} AS residual FROM ({FIT})")
def _(t):
    return R.residuals(fitted(t), "y", "p", ["l_orderkey", "l_linenumber"]).withColumn("residual", r("residual"))


DIST = "sqrt(list_sum([(x[1] - x[2]) * (x[1] - x[2]) for x in list_zip(a.embedding::double[], b.embedding::double[])]))"


@query("met_silhouette", f"""
WITH s AS (SELECT a.vec_id, a.label AS c, b.label AS o, sum({DIST}) AS total, count(*) AS n
 FROM embeddings a, embeddings b GROUP BY 1, 2, 3),
v AS (SELECT vec_id, max(CASE WHEN c = o THEN total / nullif(n - 1, 0) END) AS a, min(CASE WHEN c <> o THEN total / n END) AS b FROM s GROUP BY 1)
SELECT {sr('avg(CASE WHEN a IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END)')} AS silhouette FROM v""")
def _(t):
    return rounded(K.silhouette(t.embeddings, "vec_id", "label", "embedding"))


CENTRES = """WITH e AS (SELECT vec_id, label, unnest(embedding::double[]) AS x, unnest(range(len(embedding))) AS d FROM embeddings),
m AS (SELECT label, d, avg(x) AS m, count(*) AS n FROM e GROUP BY 1, 2),
p AS (SELECT vec_id, label, sqrt(sum((x - m) * (x - m))) AS dist, sum((x - m) * (x - m)) AS sq FROM e JOIN m USING (label, d) GROUP BY 1, 2)
"""


@query("met_davies_bouldin", CENTRES + f""", s AS (SELECT label, avg(dist) AS s FROM p GROUP BY 1),
g AS (SELECT a.label AS i, b.label AS j, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS gap FROM m a JOIN m b ON a.d = b.d AND a.label <> b.label GROUP BY 1, 2),
w AS (SELECT i, max((si.s + sj.s) / gap) AS worst FROM g JOIN s si ON si.label = i JOIN s sj ON sj.label = j GROUP BY 1)
SELECT {sr('avg(worst)')} AS davies_bouldin FROM w""")
def _(t):
    return rounded(K.davies_bouldin(t.embeddings, "label", "embedding"))


@query("met_calinski", CENTRES + f""", o AS (SELECT d, avg(x) AS g FROM e GROUP BY 1),
b AS (SELECT sum(n * (m - g) * (m - g)) AS bss, count(DISTINCT label) AS k FROM m JOIN o USING (d))
SELECT {sr('(bss / (k - 1)) / ((SELECT sum(sq) FROM p) / ((SELECT count(*) FROM embeddings) - k))', 4)} AS calinski_harabasz FROM b""")
def _(t):
    return rounded(K.calinski_harabasz(t.embeddings, "label", "embedding"), 4)


CROSS = """WITH c AS (SELECT o_orderstatus AS a, o_custkey % 3 AS b, count(*) AS n FROM orders GROUP BY 1, 2),
ra AS (SELECT a, sum(n) AS n FROM c GROUP BY 1), rb AS (SELECT b, sum(n) AS n FROM c GROUP BY 1)
"""


def labelled(t):
    return t.orders.select("o_orderstatus", (F.col("o_custkey") % 3).alias("b"))


@query("met_ari", CROSS + f""", v AS (SELECT (SELECT sum(n * (n - 1) / 2.0::double) FROM c) AS pairs, (SELECT sum(n * (n - 1) / 2.0::double) FROM ra) AS ra,
 (SELECT sum(n * (n - 1) / 2.0::double) FROM rb) AS rb, (SELECT sum(n) * (sum(n) - 1) / 2.0::double FROM c) AS allp)
SELECT {sr('(pairs - ra * rb / allp) / ((ra + rb) / 2.0::double - ra * rb / allp)')} AS ari FROM v""")
def _(t):
    return rounded(K.adjusted_rand(labelled(t), "o_orderstatus", "b"))


@query("met_nmi", CROSS + f""", z AS (SELECT sum(n)::double AS t FROM c),
v AS (SELECT (SELECT sum(c.n / t * ln(c.n * t / (ra.n * rb.n))) FROM c JOIN ra USING (a) JOIN rb USING (b), z) AS mi,
 (SELECT -sum(n / t * ln(n / t)) FROM ra, z) AS ha, (SELECT -sum(n / t * ln(n / t)) FROM rb, z) AS hb)
SELECT {sr('mi / ((ha + hb) / 2.0::double)', 9)} AS nmi FROM v""")
def _(t):
    return rounded(K.normalized_mutual_info(labelled(t), "o_orderstatus", "b"), 9)


@query("met_compare", f"""
WITH x AS ({RESULTS}), w AS (SELECT model, max(value) FILTER (WHERE metric = 'mae') AS mae, max(value) FILTER (WHERE metric = 'rmse') AS rmse FROM x GROUP BY 1)
SELECT model, 'mae' AS metric, mae AS value FROM w UNION ALL SELECT model, 'rmse', rmse FROM w""")
def _(t):
    return long(wide(run_results(t), ["mae", "rmse"]), ["mae", "rmse"])
