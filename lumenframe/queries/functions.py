"""Scalar function queries on texts made from the tables."""

from pyspark.sql import functions as F

from lumenframe.functions import text as X
from lumenframe.operators import profile as P
from lumenframe.queries.profile import MEASURES, corr_sql
from lumenframe.queries.registry import query, r, sr

# Replies with JSON inside: flat, nested with Python constants in a fence, none, and cut off.
REPLY = {
    0: "concat('answer: ', props, ' end }')",
    1: "concat('```json\n{\"a\": ', props, ', \"ok\": True, \"none\": None}\n``` {\"late\": 1}')",
    2: "concat('nothing here for ', event_type)",
    3: "concat('{ \"cut\": ', event_type)",
    4: "concat('bad {', event_type, ': 1} ', props)",
}
REPLY_SQL = "CASE event_id % 5 " + " ".join(f"WHEN {i} THEN {e}" for i, e in REPLY.items()) + " END"


def replies(t):
    return t.events.select("event_id", F.expr(REPLY_SQL.replace("\n", "\\n")).alias("raw"))


@query("fn_json_extract", f"""
WITH x AS (SELECT event_id, trim(regexp_replace({REPLY_SQL}, '```json|```', '', 'g'), E' \\n\\t') AS t FROM events),
c AS (SELECT event_id, nullif(regexp_extract(t, '\\{{[^{{}}]*(?:\\{{[^{{}}]*\\}}[^{{}}]*)*\\}}'), '') AS c FROM x),
f AS (SELECT event_id, replace(replace(replace(c, 'None', 'null'), 'True', 'true'), 'False', 'false') AS c FROM c)
SELECT event_id, CASE WHEN json_valid(c) THEN c END AS json FROM f""")
def _(t):
    return replies(t).select("event_id", X.first_json(F.col("raw")).alias("json"))


CODE = {
    0: "concat('Sure:\n```python\n', text, '\n```\nDone')",
    1: "concat('See ```\n', text, '\n``` and more')",
    2: "concat(' Some words\nimport os\n', text)",
    3: "concat('no code ', role)",
}
CODE_SQL = "CASE (conv_id + turn) % 4 " + " ".join(f"WHEN {i} THEN {e}" for i, e in CODE.items()) + " END"


@query("fn_code_fence", rf"""
WITH x AS (SELECT conv_id, turn, regexp_replace({CODE_SQL}, '^\s+|\s+$', '', 'g') AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN regexp_matches(t, '(?s)```python\s*(.*?)```') THEN regexp_replace(regexp_extract(t, '(?s)```python\s*(.*?)```', 1), '^\s+|\s+$', '', 'g')
 WHEN regexp_matches(t, '(?s)```(.*?)```') THEN regexp_replace(regexp_extract(t, '(?s)```(.*?)```', 1), '^\s+|\s+$', '', 'g')
 WHEN regexp_matches(t, '(?s)((?:^|\n)(?:import |from |def |class ).*)') THEN regexp_replace(regexp_extract(t, '(?s)((?:^|\n)(?:import |from |def |class ).*)', 1), '^\s+|\s+$', '', 'g') END AS code FROM x""")
def _(t):
    raw = F.expr(CODE_SQL.replace("\n", "\\n"))
    return t.conversations.select("conv_id", "turn", X.code_block(raw).alias("code"))


MARKED = "concat('log <<<PLOTLY_START>>> ', props, ' <<<PLOTLY_END>>> mid <<<PLOTLY_START>>>', event_type, '<<<PLOTLY_END>>> rest')"


@query("fn_marker_blocks", f"""
WITH b AS (SELECT event_id, regexp_extract_all({MARKED}, '(?s)<<<PLOTLY_START>>>(.*?)<<<PLOTLY_END>>>', 1) AS b FROM events),
u AS (SELECT event_id, unnest(b) AS block, unnest(range(len(b))) AS block_no FROM b)
SELECT event_id, block_no, trim(block) AS block, CASE WHEN NOT json_valid(trim(block)) THEN 'Invalid JSON' END AS error FROM u""")
def _(t):
    return X.marked_blocks(t.events.select("event_id", F.expr(MARKED).alias("out")), "event_id", "out")


PATH = "concat('up.load/', source, '/doc_', doc_id, CASE doc_id % 4 WHEN 0 THEN '.CSV' WHEN 1 THEN '.tar.json' WHEN 2 THEN '' ELSE '.xlsx' END)"


@query("fn_file_ext", f"SELECT doc_id, lower(regexp_extract({PATH}, '[^/.][.]([^./]+)$', 1)) AS ext FROM documents")
def _(t):
    return t.documents.select("doc_id", X.file_extension(F.expr(PATH)).alias("ext"))


@query("fn_round_fixed", "SELECT event_id, round(value / 7, 2) AS two, printf('%.4f', value / 7) AS four FROM events")
def _(t):
    x = F.col("value") / 7
    return t.events.select("event_id", F.round(x, 2).alias("two"), X.fixed(x).alias("four"))


TITLE = "concat(event_type, '_per_', event_type)"


@query("fn_title_case", f"""
SELECT event_id, array_to_string([upper(w[1]) || lower(w[2:]) for w in string_split({TITLE}, '_')], ' ') AS title FROM events""")
def _(t):
    return t.events.select("event_id", X.title_case(F.expr(TITLE)).alias("title"))


@query("fn_truncate", "SELECT doc_id, left(text, 50) || '...' AS short FROM documents")
def _(t):
    return t.documents.select("doc_id", X.shorten(F.col("text")).alias("short"))


@query("fn_iso_time", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS iso, strftime(ts, '%Y-%m-%d %H:%M:%S') AS shown FROM events")
def _(t):
    return t.events.select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("iso"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("shown"))


MIXED = "CASE event_id % 4 WHEN 0 THEN concat(' ', user_id) WHEN 1 THEN concat('', value) WHEN 2 THEN event_type END"


@query("fn_to_number", f"""
WITH x AS (SELECT event_id, {MIXED} AS raw FROM events)
SELECT event_id, CASE WHEN regexp_matches(trim(raw), '^[+-]?[0-9]+$') THEN 'int' WHEN try_cast(trim(raw) AS double) IS NOT NULL THEN 'float'
 WHEN raw IS NOT NULL THEN 'text' END AS kind, try_cast(trim(raw) AS double) AS number FROM x""")
def _(t):
    parsed = t.events.select("event_id", X.parse_number(F.expr(MIXED)).alias("p"))
    return parsed.select("event_id", "p.kind", "p.number")


NAMES = ["C", "alpha", "n_estimators", "max_depth", "learning_rate", "criterion", "n_clusters"]
NAME_SQL = f"CASE event_id % {len(NAMES)} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(NAMES)) + " END"
RAW_SQL = "CASE event_id % 5 WHEN 0 THEN concat('', user_id) WHEN 1 THEN concat('', value) WHEN 2 THEN event_type WHEN 3 THEN concat('-', user_id) END"


@query("fn_param_fix", f"""
WITH x AS (SELECT event_id AS trial, {NAME_SQL} AS param, coalesce({RAW_SQL}, '0') AS raw FROM events),
k AS (SELECT *, regexp_matches(raw, '^[+-]?[0-9]+$') AS whole, try_cast(raw AS double) AS num FROM x),
b AS (SELECT *, coalesce(param IN ('C', 'alpha', 'learning_rate') AND (num IS NULL OR num <= 0), false)
  OR (param IN ('n_estimators', 'n_clusters') AND (NOT whole OR num <= 0)) AS reset,
  param = 'max_depth' AND (NOT whole OR num <= 0) AS unlimited FROM k)
SELECT trial, param, CASE WHEN reset THEN 1.0 WHEN unlimited THEN NULL ELSE num END AS value,
 CASE WHEN num IS NULL AND NOT reset AND NOT unlimited THEN raw END AS text, reset OR unlimited AS changed FROM b""")
def _(t):
    listed = t.events.select(
        F.col("event_id").alias("trial"), F.expr(NAME_SQL).alias("param"), F.array(F.lit(None).cast("string"), F.expr(RAW_SQL), F.lit("0")).alias("given"))
    fixed = listed.select("trial", "param", X.repair_parameter(F.col("param"), F.col("given")).alias("p"))
    return fixed.select("trial", "param", "p.value", "p.text", "p.changed")


@query("fn_map_get", """
SELECT event_id, CASE WHEN event_type = 'click' THEN json_extract_string(props, '$.k') ELSE 'default' END AS method FROM events""")
def _(t):
    results = F.create_map(F.col("event_type"), F.from_json("props", "map<string,string>"))
    return t.events.select("event_id", X.nested_get(results, "click", "k", F.lit("default")).alias("method"))


@query("fn_dict_invert", """
SELECT p_brand, '{' || string_agg('"' || p_type || '":' || n, ',' ORDER BY p_type) || '}' AS described
FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2) GROUP BY 1""")
def _(t):
    counts = t.part.groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    entries = F.array_sort(F.collect_list(F.struct("p_type", "n")))
    return counts.groupBy("p_brand").agg(F.to_json(F.map_from_entries(entries)).alias("described"))


@query("fn_residual", f"SELECT l_orderkey, l_linenumber, l_partkey, {sr('l_extendedprice - 1000 * l_quantity')} AS residual FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", r(F.col("l_extendedprice") - 1000 * F.col("l_quantity")).alias("residual"))


@query("fn_json_col", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE json_extract(props, '$.k')::bigint END AS k FROM events""")
def _(t):
    stored = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("broken "), "event_type")).otherwise(F.col("props"))
    typed = F.from_json(stored, "k long", {"mode": "PERMISSIVE"})
    return t.events.select("event_id", F.coalesce(typed["k"], F.lit(-1)).alias("k"))


@query("fn_corr_band", f"""
WITH c AS ({corr_sql('lineitem', MEASURES)})
SELECT "row", col, CASE WHEN corr = 1 THEN 'primary' WHEN corr >= 0.75 THEN 'accent' WHEN corr >= 0.5 THEN 'mid' WHEN corr > 0 THEN 'low'
 WHEN corr = 0 THEN 'zero' WHEN corr > -0.5 THEN 'cool' WHEN corr >= -0.75 THEN 'secondary' ELSE 'secondary_dark' END AS band FROM c""")
def _(t):
    return P.correlation(t.lineitem, MEASURES).select("row", "col", X.correlation_band(r("corr")).alias("band"))
