"""Projection, filter and repair queries."""

from pyspark.sql import functions as F

from lumenframe.operators import project as J
from lumenframe.operators.project import MODEL_ALIASES, OFFICIAL_MODELS
from lumenframe.queries.registry import query

WILD = (
    "SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'Infinity'::double WHEN event_id % 13 = 0 THEN '-Infinity'::double "
    "ELSE value END AS value FROM events"
)


def wild(t):
    return t.events.select(
        "event_id",
        F.expr("case when event_id % 11 = 0 then double('Infinity') when event_id % 13 = 0 then double('-Infinity') else value end")
        .alias("value"),
    )


@query("proj_split_xy", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice AS target FROM part")
def _(t):
    from lumenframe.plans.roles import Roles

    return Roles("p_retailprice").mark(t.part).select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "target")


@query("proj_drop_columns", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(t):
    return J.drop_columns(t.orders, ["o_orderstatus", "o_orderdate", "o_orderpriority", "absent"])


@query("proj_select_numeric", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def _(t):
    return J.select_numeric(t.customer)


@query("proj_select_object", "SELECT p_name, p_brand, p_type FROM part")
def _(t):
    return J.select_text(t.part)


@query("flt_notnull_col", "SELECT event_id, nullif(event_type, 'error') AS event_type FROM events WHERE event_type <> 'error'")
def _(t):
    return J.keep_present(t.events.select("event_id", F.expr("nullif(event_type, 'error')").alias("event_type")), "event_type")


@query("flt_isin", """
SELECT p_partkey, p_brand FROM part WHERE p_brand IN
 (SELECT p_brand FROM part GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 15)""")
def _(t):
    return J.keep_top_values(t.part, "p_brand", 15).select("p_partkey", "p_brand")


@query("flt_bool_mask", """
SELECT l_orderkey, l_quantity, l_extendedprice, (l_quantity > 45 OR l_extendedprice > 45) AS some_large
FROM lineitem WHERE l_quantity > 10 AND l_extendedprice > 10""")
def _(t):
    cols = ["l_quantity", "l_extendedprice"]
    kept = t.lineitem.where(J.all_columns(cols, lambda c: c > 10))
    return kept.select("l_orderkey", *cols, J.any_column(cols, lambda c: c > 45).alias("some_large"))


@query("proj_rename", """
SELECT s_suppkey AS supplier, s_acctbal AS balance,
 CASE WHEN s_acctbal < 0 THEN 'negative' ELSE 'positive' END AS sign FROM supplier""")
def _(t):
    named = J.rename(t.supplier, {"s_suppkey": "supplier", "s_acctbal": "balance"})
    raw = named.select("supplier", "balance", F.when(F.col("balance") < 0, "neg").otherwise("positive").alias("sign"))
    return J.rename_values(raw, "sign", {"neg": "negative"})


@query("proj_replace_inf", f"SELECT event_id, CASE WHEN isinf(value) THEN 0.0 ELSE value END AS value FROM ({WILD})")
def _(t):
    return J.replace_infinite(wild(t))


@query("proj_fillna_zero", """
SELECT event_id, coalesce(nullif(event_type, 'error'), '0') AS event_type,
 CASE WHEN event_id % 7 = 0 OR event_id % 13 = 0 THEN 0.0 ELSE value END AS value FROM events""")
def _(t):
    return J.fill_zero(
        t.events.select(
            "event_id",
            F.expr("nullif(event_type, 'error')").alias("event_type"),
            F.expr("case when event_id % 7 = 0 then null when event_id % 13 = 0 then double('NaN') else value end").alias("value"),
        )
    )


@query("proj_method_check", """
SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN o_orderpriority ELSE '3-MEDIUM' END AS method
FROM orders""")
def _(t):
    return t.orders.select(
        "o_orderkey",
        J.checked_method(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH", "3-MEDIUM"], "3-MEDIUM").alias("method"),
    )


# Names as a service may write them, picked per row; some are not model names at all.
ASKED = ["SVM", "KMeans", "Ridge", "XGBoost", "RandomForest", "Random Forest Classifier", "svm", "Perceptron", "ElasticNetRegressor"]


def _asked_sql():
    cases = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(ASKED))
    official = "', '".join(OFFICIAL_MODELS)
    alias = " ".join(f"WHEN '{a}' THEN '{o}'" for a, o in MODEL_ALIASES.items())
    return f"""
WITH a AS (SELECT event_id, CASE event_id % {len(ASKED)} {cases} END AS asked FROM events)
SELECT event_id, asked, CASE asked {alias} ELSE CASE WHEN asked IN ('{official}') THEN asked END END AS model FROM a"""


@query("proj_model_alias", _asked_sql())
def _(t):
    names = F.array(*map(F.lit, ASKED))
    asked = t.events.select("event_id", names[(F.col("event_id") % len(ASKED)).cast("int")].alias("asked"))
    return asked.withColumn("model", J.official_model(F.col("asked")))
