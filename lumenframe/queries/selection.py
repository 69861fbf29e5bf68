"""Feature selection queries."""

from pyspark.sql import functions as F

from lumenframe.operators import select as S
from lumenframe.queries.profile import LINE_NUMERIC
from lumenframe.queries.registry import query, rounded, sr, union_all

FEATURES = [c for c in LINE_NUMERIC]


@query("fs_variance", union_all(
    f"SELECT '{c}' AS \"column\", {sr(f'var_pop({c})', 2)} AS variance, var_pop({c}) > 0 AS kept FROM (SELECT *, 1.0::double AS one FROM lineitem)"
    for c in [*FEATURES, "one"]))
def _(t):
    return rounded(S.variances(t.lineitem.withColumn("one", F.lit(1.0)), [*FEATURES, "one"]), 2)


def anova_sql(cols, target, source, k):
    one = union_all(
        f"SELECT '{c}' AS \"column\", {target} AS y, count({c}) AS n, avg({c}) AS m, var_pop({c}) AS v, (SELECT avg({c}) FROM {source}) AS g FROM {source} GROUP BY {target}"
        for c in cols)
    return f"""WITH c AS ({one}),
f AS (SELECT "column", (sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS score FROM c GROUP BY "column"),
z AS (SELECT "column", score, row_number() OVER (ORDER BY score DESC, "column") AS rank FROM f)
SELECT "column", {sr('score', 4)} AS score, rank, rank <= {k} AS kept FROM z"""


@query("fs_anova", anova_sql(FEATURES, "l_returnflag", "lineitem", 5))
def _(t):
    return rounded(S.anova(t.lineitem, "l_returnflag", FEATURES, k=5), 4)


REG = [c for c in FEATURES if c != "l_extendedprice"]


@query("fs_freg", f"""
WITH c AS ({union_all(f"SELECT '{c}' AS c, corr({c}, l_extendedprice) AS r, count(*) AS n FROM lineitem" for c in REG)}),
f AS (SELECT c AS "column", r * r / (1.0 - r * r) * (n - 2) AS score FROM c),
z AS (SELECT "column", score, row_number() OVER (ORDER BY score DESC, "column") AS rank FROM f)
SELECT "column", {sr('score', 4)} AS score, rank, rank <= 5 AS kept FROM z""")
def _(t):
    return rounded(S.f_regression(t.lineitem, "l_extendedprice", REG, k=5), 4)


RFE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@query("fs_rfe_lr")
def _(t):
    return S.eliminate(t.lineitem, "l_returnflag", RFE, keep=3)


@query("fs_rfe_rf")
def _(t):
    return S.eliminate(t.lineitem, "l_returnflag", RFE, model="forest", keep=3)


@query("fs_pca2")
def _(t):
    return rounded(S.components(t.embeddings, "embedding").select("vec_id", "label", "pc1", "pc2"))
