"""Source and sink queries: tables are written to the shared folder and read back."""

import pandas as pd
from pyspark.sql import functions as F

from lumenframe.functions import text as X
from lumenframe.models import training as M
from lumenframe.models.training import TrainingConfig
from lumenframe.operators import joins as J
from lumenframe.plans.report import metric_lines
from lumenframe.queries.registry import query, r, sr, union_all
from lumenframe.queries.windows import RESULTS, run_results
from lumenframe.session import scratch_path
from lumenframe.sources import readers as R
from lumenframe.sources import writers as W

PART = ["p_partkey", "p_name", "p_brand", "p_size", "p_retailprice"]
PART_DDL = "p_partkey long, p_name string, p_brand string, p_size int, p_retailprice double"
PART_SQL = "SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part"
INFERRED_SQL = "SELECT p_partkey::int AS p_partkey, p_name, p_brand, p_size, p_retailprice FROM part"
LONG_SQL = "SELECT p_partkey, p_name, p_brand, p_size::bigint AS p_size, p_retailprice FROM part"


def part(t):
    return t.part.select(*PART)


@query("src_csv", INFERRED_SQL)
def _(t):
    path = scratch_path(t.spark, "csv")
    W.write_csv(part(t), path)
    return R.load(t.spark, path, "csv")


@query("src_json", LONG_SQL)
def _(t):
    """Files that each hold one JSON array of records."""

    def arrays(batches):
        for b in batches:
            if len(b):
                yield pd.DataFrame({"value": ["[" + ",".join(b["value"]) + "]"]})

    records = part(t).select(F.to_json(F.struct(*PART)).alias("value"))
    path = scratch_path(t.spark, "json")
    records.mapInPandas(arrays, "value string").write.option("maxRecordsPerFile", 1).text(path)
    return R.load(t.spark, path, "json")


@query("src_xml", LONG_SQL)
def _(t):
    path = scratch_path(t.spark, "xml")
    W.write_xml(part(t), path)
    return R.load(t.spark, path, "xml")


@query("src_excel", PART_SQL)
def _(t):
    """Sheets in the form that spreadsheet programs export."""
    path = scratch_path(t.spark, "sheet")
    W.write(part(t), path, "excel")
    return R.read_sheet(t.spark, path, PART_DDL)


@query("src_sql", "SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS balance FROM customer GROUP BY c_mktsegment")
def _(t):
    return R.read_sql(t.spark, "SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS balance FROM {customer} GROUP BY c_mktsegment",
                      {"customer": t.customer})


@query("src_npy", "SELECT " + ", ".join(f"embedding[{i + 1}]::double AS \"{i}\"" for i in range(64)) + " FROM embeddings")
def _(t):
    path = scratch_path(t.spark, "matrix")
    t.embeddings.select(*[F.col("embedding")[i].cast("double").alias(str(i)) for i in range(64)]).write.csv(path)
    return R.read_matrix(t.spark, path, 64)


def written_files(t, small="json"):
    """The orders in three formats, one folder each; the files of ``small`` hold one row each."""
    path = scratch_path(t.spark, "files")
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    for kind in ("csv", "json", "xml"):
        W.write(rows.coalesce(1) if kind != small else t.region.select("r_regionkey").repartition(5), f"{path}/{kind}", kind)
    return R.list_files(t.spark, path)


def kept_kinds(files, kept):
    """Per kind: whether any and whether all of its files stay."""
    marked = files.join(kept.select("path", F.lit(True).alias("stays")), "path", "left")
    stays = F.coalesce("stays", F.lit(False))
    return marked.where(F.col("kind").isin("csv", "json", "xml")).groupBy("kind").agg(F.bool_or(stays).alias("any_kept"), F.bool_and(stays).alias("all_kept"))


KINDS = "SELECT unnest(['csv', 'json', 'xml']) AS kind, unnest({a}) AS any_kept, unnest({b}) AS all_kept"


@query("src_filter_ext", KINDS.format(a="[true, true, false]", b="[true, true, false]"))
def _(t):
    files = written_files(t)
    return kept_kinds(files, R.allowed(files))


@query("src_filter_size", KINDS.format(a="[false, true, false]", b="[false, true, false]"))
def _(t):
    """The whole table is over the limit in every format, files of one row are not."""
    files = written_files(t)
    return kept_kinds(files, R.small_enough(files, 10_000))


@query("snk_csv", PART_SQL)
def _(t):
    path = scratch_path(t.spark, "out")
    W.write(part(t), path, "csv")
    return R.read_csv(t.spark, path, PART_DDL)


GAP = "SELECT event_id, nullif(event_type, 'error') AS event_type, value FROM events"


@query("snk_json", GAP)
def _(t):
    path = scratch_path(t.spark, "out")
    W.write(t.events.select("event_id", F.expr("nullif(event_type, 'error')").alias("event_type"), "value"), path, "json")
    return R.read_json(t.spark, path, "event_id long, event_type string, value double", lines=True)


@query("snk_xml", GAP)
def _(t):
    path = scratch_path(t.spark, "out")
    W.write(t.events.select("event_id", F.expr("nullif(event_type, 'error')").alias("event_type"), "value"), path, "xml")
    return R.read_xml(t.spark, path, schema="event_id long, event_type string, value double")


@query("snk_excel", PART_SQL)
def _(t):
    path = scratch_path(t.spark, "out")
    W.write(part(t), path, "excel")
    return t.spark.read.schema(PART_DDL).csv(path, header=True, escape='"', enforceSchema=True)


@query("snk_metrics", RESULTS)
def _(t):
    path = scratch_path(t.spark, "metrics")
    W.write_metrics(run_results(t), path)
    return t.spark.read.schema("model string, metric string, value double").json(path)


@query("snk_model", f"""
WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem)
SELECT l_quantity, {sr('a * l_quantity + b', 2)} AS prediction FROM lineitem, f""")
def _(t):
    """A fitted pipeline (a line) is saved, read back, and scores the table."""
    data = t.lineitem.select(F.monotonically_increasing_id().alias("row"), "l_quantity", "l_extendedprice")
    config = TrainingConfig("regression", "Linear Regression", "row", "l_extendedprice")
    prepare, model, _ = M.fit(M.shaped(data, config), config)
    path = scratch_path(t.spark, "model")
    M.save(prepare, model, path)
    return M.predict_batch(data.drop("l_extendedprice"), path, config).select("l_quantity", r("prediction", 2).alias("prediction"))


IMPORTANCE = union_all(f"SELECT '{c}' AS feature, round(abs(corr({c}, l_extendedprice)), 6) AS importance FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax"))


@query("snk_report", f"""
WITH m AS (SELECT 0 AS part, 0.0::double AS place, model || '.' || metric AS name, value AS v FROM ({RESULTS})),
i AS (SELECT 1 AS part, -importance AS place, feature AS name, importance AS v FROM ({IMPORTANCE})),
a AS (SELECT * FROM m UNION ALL SELECT * FROM i)
SELECT '| ' || name || ' | ' || printf('%.4f', v) || ' |' AS line FROM a""")
def _(t):
    metrics = run_results(t).select(F.concat_ws(".", "model", "metric").alias("metric"), "value")
    row = t.lineitem.agg(*[r(F.abs(F.corr(c, "l_extendedprice"))).alias(c) for c in ("l_quantity", "l_discount", "l_tax")])
    importance = row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("importance")) for c in row.columns])))
    path = scratch_path(t.spark, "report")
    W.write_report(metric_lines(metrics, importance), path)
    return t.spark.read.text(path).select(F.col("value").alias("line"))


STATUS = "SELECT o_custkey, o_orderkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM orders"


@query("snk_upsert", """
SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def _(t):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderstatus")
    old, new = rows.where("o_orderstatus <> 'P'"), rows.where("o_orderstatus = 'P'")
    path = scratch_path(t.spark, "stored")
    W.store(old, path)
    W.update_stored(t.spark, path, lambda stored: J.upsert(stored, new, "o_custkey", "o_orderkey"))
    return W.read_stored(t.spark, path)


@query("snk_upsert_partial", """
WITH old AS (SELECT c_custkey AS k, c_mktsegment AS algorithm, c_acctbal AS split FROM customer WHERE c_acctbal > 0),
new AS (SELECT user_id AS k, CASE WHEN count(*) % 2 = 0 THEN 'updated' END AS algorithm FROM events GROUP BY user_id)
SELECT coalesce(o.k, n.k) AS k, coalesce(n.algorithm, o.algorithm, CASE WHEN o.k IS NULL THEN 'default' END) AS algorithm,
 coalesce(o.split, CASE WHEN o.k IS NULL THEN 0.2 END) AS split FROM old o FULL JOIN new n ON o.k = n.k""")
def _(t):
    old = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("algorithm"), F.col("c_acctbal").alias("split"))
    new = t.events.groupBy(F.col("user_id").alias("k")).agg(F.expr("case when count(*) % 2 = 0 then 'updated' end").alias("algorithm"))
    path = scratch_path(t.spark, "stored")
    W.store(old, path)
    W.update_stored(t.spark, path, lambda stored: J.upsert_partial(stored, new, "k", {"algorithm": "default", "split": 0.2}))
    return W.read_stored(t.spark, path)


TABLE_HTML = ("concat('<h1>', page_id, '</h1><table class=\"t\"><tr><th> page </th><th>url</th></tr>\n<tr><td>', page_id, "
              "'</td><td> <b>', html, '</b>\n</td></tr></table><table><tr><td>second</td></tr></table>')")


@query("snk_csv_from_html", r"""
WITH h AS (SELECT page_id, regexp_extract(""" + TABLE_HTML.replace("\n", "' || chr(10) || '") + r""", '(?is)<table[^>]*>(.*?)</table>', 1) AS b FROM pages),
w AS (SELECT page_id, regexp_extract_all(b, '(?is)<tr[^>]*>(.*?)</tr>', 1) AS rows FROM h),
x AS (SELECT page_id, unnest(rows) AS row, unnest(range(len(rows))) AS row_no FROM w),
c AS (SELECT page_id, row_no, regexp_extract_all(row, '(?is)<t[dh][^>]*>(.*?)</t[dh]>', 1) AS cells FROM x),
y AS (SELECT page_id, row_no, unnest(cells) AS cell, unnest(range(len(cells))) AS col_no FROM c)
SELECT page_id, row_no, col_no, regexp_replace(regexp_replace(cell, '<[^>]*>', '', 'g'), '^\s+|\s+$', '', 'g') AS text FROM y""")
def _(t):
    pages = t.pages.select("page_id", F.expr(TABLE_HTML.replace("\n", "\\n")).alias("html"))
    return X.table_cells(pages, "page_id", "html")


@query("snk_blocks_from_html", rf"""
WITH b AS (SELECT page_id, regexp_extract_all(html, '{X.BLOCK_PATTERN}', 1) AS b FROM pages)
SELECT page_id, unnest(range(len(b))) AS block_no, unnest(b) AS block FROM b""")
def _(t):
    return X.html_blocks(t.pages, "page_id", "html")
