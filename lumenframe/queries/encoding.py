"""De-duplication and encoding queries."""

from pyspark.sql import functions as F

from lumenframe.operators import encode as E
from lumenframe.queries.registry import query, r, sr

TOKEN_SQL = r"[\p{L}\p{N}_]{2,}"
TERMS = f"""WITH c AS (SELECT doc_id, term, count(*) AS n FROM
 (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{TOKEN_SQL}')) AS term FROM documents) GROUP BY doc_id, term)
"""


@query("dedup_rows", "SELECT DISTINCT p_brand, p_type, p_size FROM part")
def _(t):
    return E.drop_duplicates(t.part.select("p_brand", "p_type", "p_size"))


@query("enc_label", """
SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS p_brand,
 dense_rank() OVER (ORDER BY coalesce(nullif(p_type, 'PROMO'), 'nan')) - 1 AS p_type FROM part""")
def _(t):
    return E.label(t.part.select("p_partkey", "p_brand", F.expr("nullif(p_type, 'PROMO')").alias("p_type")))


@query("enc_label_target", "SELECT l_orderkey, l_quantity, dense_rank() OVER (ORDER BY l_returnflag) - 1 AS l_returnflag FROM lineitem")
def _(t):
    return E.label_target(t.lineitem.select("l_orderkey", "l_quantity", "l_returnflag"), "l_returnflag")


@query("enc_ordinal", "SELECT p_partkey, (dense_rank() OVER (ORDER BY p_name) - 1)::double AS p_name FROM part")
def _(t):
    return E.ordinal(t.part.select("p_partkey", "p_name"))


@query("enc_onehot", """
SELECT o_orderkey, (o_orderstatus = 'F')::int AS "o_orderstatus_F", (o_orderstatus = 'O')::int AS "o_orderstatus_O",
 (o_orderstatus = 'P')::int AS "o_orderstatus_P" FROM orders""")
def _(t):
    return E.one_hot(t.orders.select("o_orderkey", "o_orderstatus"))


@query("enc_catcodes", """
SELECT event_id, CASE WHEN event_type = 'error' THEN -1 ELSE
 dense_rank() OVER (PARTITION BY event_type = 'error' ORDER BY event_type) - 1 END AS event_type FROM events""")
def _(t):
    return E.category_codes(t.events.select("event_id", F.expr("nullif(event_type, 'error')").alias("event_type")))


@query("enc_count_vec", TERMS + "SELECT * FROM c")
def _(t):
    return E.term_counts(t.documents, "doc_id", "text")


@query("enc_tfidf", TERMS + f""", d AS (SELECT term, count(*) AS df FROM c GROUP BY term),
w AS (SELECT doc_id, term, n * (ln((1.0::double + (SELECT count(*) FROM documents)) / (1.0::double + df)) + 1.0::double) AS w FROM c JOIN d USING (term))
SELECT doc_id, term, {sr('w / sqrt(sum(w * w) OVER (PARTITION BY doc_id))')} AS weight FROM w""")
def _(t):
    return E.tf_idf(t.documents, "doc_id", "text").withColumn("weight", r("weight"))
