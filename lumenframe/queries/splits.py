"""Split and fold queries."""

from lumenframe.operators import splits as S
from lumenframe.queries.registry import query

HASH = "md5(concat(o_orderkey::varchar, '|42'))"
COLS = ["o_orderkey", "o_orderstatus"]


@query("split_holdout", f"""
SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY {HASH}) <= ceil(0.2 * (SELECT count(*) FROM orders)) AS is_test FROM orders""")
def _(t):
    return S.holdout(t.orders.select(*COLS), "o_orderkey", 0.2)


def stratified_sql(fraction):
    return f"""n AS (SELECT o_orderstatus AS s, count(*) AS n, (SELECT count(*) FROM orders) AS total,
 (SELECT ceil({fraction} * count(*))::bigint FROM orders) AS want FROM orders GROUP BY 1),
q AS (SELECT s, n * want // total AS base, want, row_number() OVER (ORDER BY n * want % total DESC, s) AS place FROM n),
k AS (SELECT s, base + CASE WHEN place <= want - (SELECT sum(base) FROM q) THEN 1 ELSE 0 END AS quota FROM q),
x AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {HASH}) <= quota AS is_test
 FROM orders JOIN k ON s = o_orderstatus)"""


@query("split_stratified", f"WITH {stratified_sql('0.2')} SELECT * FROM x")
def _(t):
    return S.holdout(t.orders.select(*COLS), "o_orderkey", 0.2, by="o_orderstatus")


@query("split_sample25", f"WITH {stratified_sql('0.25')} SELECT o_orderkey, o_orderstatus FROM x WHERE is_test")
def _(t):
    return S.sample_when_large(t.orders.select(*COLS), "o_orderkey", "o_orderstatus")


@query("cv_kfold", f"""
WITH x AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY {HASH}) - 1 AS i, (SELECT count(*) FROM orders) AS n FROM orders)
SELECT o_orderkey, o_orderstatus, CASE WHEN i < (n % 7) * (n // 7 + 1) THEN i // (n // 7 + 1)
 ELSE (i - (n % 7) * (n // 7 + 1)) // (n // 7) + n % 7 END AS fold FROM x""")
def _(t):
    return S.k_folds(t.orders.select(*COLS), "o_orderkey", 7)


@query("cv_stratified", f"""
WITH c AS (SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1),
o AS (SELECT s, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM c)
SELECT o_orderkey, o_orderstatus, ((start + row_number() OVER (PARTITION BY o_orderstatus ORDER BY {HASH}) - 1) % 5)::bigint AS fold
FROM orders JOIN o ON s = o_orderstatus""")
def _(t):
    return S.stratified_folds(t.orders.select(*COLS), "o_orderkey", "o_orderstatus", 5)
