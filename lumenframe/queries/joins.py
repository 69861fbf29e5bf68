"""Join and set queries: customers stand for parents, orders and events for their children."""

from pyspark.sql import functions as F

from lumenframe.operators import joins as J
from lumenframe.operators.neighbors import nearest
from lumenframe.queries.profile import fence_sql
from lumenframe.queries.registry import query, r, rounded, sr


@query("join_align", "SELECT p_partkey, p_brand, p_size, p_retailprice FROM part")
def _(t):
    x = t.part.select("p_partkey", "p_brand", "p_size")
    return J.align(x, t.part.select("p_partkey", "p_retailprice"), "p_partkey")


@query("join_left_align", f"""
SELECT event_id, user_id, CASE WHEN value < lo OR value > hi THEN NULL ELSE value END AS value FROM events, ({fence_sql('events', 'value')})""")
def _(t):
    from lumenframe.operators.outliers import iqr

    whole = t.events.select("event_id", "user_id", "value")
    return J.align_left(whole, iqr(whole, ["value"]), "event_id", ["value"])


@query("join_semi_in", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')""")
def _(t):
    wanted = t.customer.where("c_mktsegment = 'MACHINERY'")
    return J.in_keys(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), "o_custkey", wanted, "c_custkey")


def children(t):
    return {
        "final": (t.orders.where("o_orderstatus = 'F'"), "o_custkey"),
        "open": (t.orders.where("o_orderstatus = 'O' and o_totalprice > 400000"), "o_custkey"),
        "errors": (t.events.where("event_type = 'error'"), "user_id"),
        "purchases": (t.events.where("event_type = 'purchase' and value > 20"), "user_id"),
    }


CHILD_SQL = {
    "final": "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'",
    "open": "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 400000",
    "errors": "SELECT user_id AS k FROM events WHERE event_type = 'error'",
    "purchases": "SELECT user_id AS k FROM events WHERE event_type = 'purchase' AND value > 20",
}


@query("join_exists_or", "SELECT DISTINCT c_custkey, c_name FROM customer WHERE " + " OR ".join(f"c_custkey IN ({q})" for q in CHILD_SQL.values()))
def _(t):
    return J.having_any(t.customer.select("c_custkey", "c_name"), "c_custkey", list(children(t).values()))


@query("join_count_children", "SELECT * FROM (SELECT c_custkey, " + ", ".join(
    f"(SELECT count(*) FROM ({q}) WHERE k = c_custkey) AS \"{n}\"" for n, q in CHILD_SQL.items())
    + " FROM customer) WHERE " + " OR ".join(f'"{n}" > 0' for n in CHILD_SQL))
def _(t):
    return J.count_children(t.customer, "c_custkey", children(t))


@query("join_exists_flags", "SELECT c_custkey, " + ", ".join(
    f"c_custkey IN ({CHILD_SQL[n]}) AS \"has_{n}\"" for n in ("final", "errors")) + " FROM customer")
def _(t):
    kids = children(t)
    return J.child_flags(t.customer, "c_custkey", {f"has_{n}": kids[n] for n in ("final", "errors")})


@query("join_fk_lookup", """
SELECT l_orderkey, l_linenumber, l_partkey, o_orderpriority, c_name, n_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def _(t):
    steps = [
        (t.orders.select("o_orderkey", "o_custkey", "o_orderpriority"), "l_orderkey", "o_orderkey"),
        (t.customer.select("c_custkey", "c_name", "c_nationkey"), "o_custkey", "c_custkey"),
        (t.nation.select("n_nationkey", "n_name"), "c_nationkey", "n_nationkey"),
    ]
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    return J.follow(lines, steps).select("l_orderkey", "l_linenumber", "l_partkey", "o_orderpriority", "c_name", "n_name")


SQUARES = "list_sum([(x[1] - x[2]) * (x[1] - x[2]) for x in list_zip(q.embedding::double[], d.embedding::double[])])"


@query("join_knn", f"""
SELECT query_key, donor_key, {sr('distance')} AS distance, rank FROM (
 SELECT q.vec_id AS query_key, d.vec_id AS donor_key, sqrt({SQUARES}) AS distance,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY sqrt({SQUARES}), d.vec_id) AS rank
 FROM embeddings q JOIN embeddings d ON q.vec_id <> d.vec_id) WHERE rank <= 5""")
def _(t):
    found = nearest(t.embeddings, t.embeddings, "vec_id", "vec_id", "embedding", 5, exclude_same_key=True)
    return rounded(found.drop("carried"))


@query("join_range_eps", f"""
SELECT a.p_partkey AS left_key, b.p_partkey AS right_key,
 {sr('sqrt((a.p_size - b.p_size) * (a.p_size - b.p_size) + (a.p_retailprice - b.p_retailprice) * (a.p_retailprice - b.p_retailprice))')} AS distance
FROM part a JOIN part b ON a.p_partkey < b.p_partkey
WHERE (a.p_size - b.p_size) * (a.p_size - b.p_size) + (a.p_retailprice - b.p_retailprice) * (a.p_retailprice - b.p_retailprice) <= 1.5 * 1.5""")
def _(t):
    return J.pairs_within(t.part, "p_partkey", ["p_size", "p_retailprice"], 1.5, shown=r)


@query("join_cascade_delete", """
WITH d AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
SELECT 'order' AS child, o_orderkey AS child_key, o_custkey AS parent FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM d)
UNION ALL SELECT 'event', event_id, CASE WHEN user_id IN (SELECT c_custkey FROM d) THEN NULL ELSE user_id END FROM events""")
def _(t):
    gone = t.customer.where("c_acctbal < 0")
    orders = J.delete_children(t.orders, "o_custkey", gone, "c_custkey")
    events = J.detach_children(t.events, "user_id", gone, "c_custkey")
    return orders.select(F.lit("order").alias("child"), F.col("o_orderkey").alias("child_key"), F.col("o_custkey").alias("parent")).union(
        events.select(F.lit("event"), "event_id", "user_id"))


@query("join_pred_truth", "SELECT doc_id, quality AS truth, (n_chars > 500)::int AS predicted FROM labels JOIN documents USING (doc_id)")
def _(t):
    predicted = t.documents.select("doc_id", (F.col("n_chars") > 500).cast("int").alias("predicted"))
    return J.pair_predictions(t.labels.select("doc_id", F.col("quality").alias("truth")), predicted, "doc_id")


@query("set_union_results", f"""
SELECT event_type AS model, {sr('avg(value)')} AS mae, NULL::double AS accuracy FROM events GROUP BY event_type
UNION ALL SELECT lang, NULL, {sr('avg((n_chars > 500)::int)')} FROM documents GROUP BY lang""")
def _(t):
    a = t.events.groupBy(F.col("event_type").alias("model")).agg(F.avg("value").alias("mae"))
    b = t.documents.groupBy(F.col("lang").alias("model")).agg(F.avg((F.col("n_chars") > 500).cast("int")).alias("accuracy"))
    return rounded(J.stack_results([a, b]))


@query("set_col_intersect", """
SELECT p_name FROM part WHERE p_size < 5 INTERSECT SELECT p_name FROM part WHERE p_size > 45""")
def _(t):
    return J.shared_names(t.part.where("p_size < 5").select("p_name"), t.part.where("p_size > 45").select("p_name"))


@query("set_train_test_except", """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN
 (SELECT o_orderkey FROM orders WHERE substr(md5(concat(o_orderkey::varchar, '|42')), 1, 1) < '4')""")
def _(t):
    from lumenframe.functions.ordering import seeded_hash

    test = t.orders.where(F.substring(seeded_hash("o_orderkey", 42), 1, 1) < "4")
    return J.all_but(t.orders.select("o_orderkey", "o_totalprice"), test, "o_orderkey")
