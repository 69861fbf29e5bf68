"""Normalisation and scaling queries."""

from pyspark.sql import functions as F

from lumenframe.operators import scale as S
from lumenframe.queries.registry import query, rounded, sr

KEY = "event_id"
COLS = ["user_id", "value"]
BASE = "SELECT event_id, user_id, value, 1.0::double AS one FROM events"


def base(t):
    return t.events.select(KEY, *COLS, F.lit(1.0).alias("one"))


def line(exprs: dict[str, str], source: str = f"({BASE})") -> str:
    cells = ", ".join(f"{sr(e)} AS {c}" for c, e in exprs.items())
    return f"SELECT event_id, {cells} FROM {source}"


def each(form: str) -> dict[str, str]:
    return {c: form.format(c=c) for c in (*COLS, "one")}


@query("norm_l1", line({c: f"{c} / (abs(user_id) + abs(value))" for c in COLS}))
def _(t):
    return rounded(S.normalize_rows(base(t), "l1", COLS).drop("one"))


@query("norm_l2", line({c: f"{c} / sqrt(user_id * user_id + value * value)" for c in COLS}))
def _(t):
    return rounded(S.normalize_rows(base(t), "l2", COLS).drop("one"))


@query("norm_max", line({c: f"{c} / greatest(abs(user_id), abs(value))" for c in COLS}))
def _(t):
    return rounded(S.normalize_rows(base(t), "max", COLS).drop("one"))


@query("scale_minmax", line(each("({c} - min({c}) OVER ()) / CASE WHEN max({c}) OVER () = min({c}) OVER () THEN 1.0 ELSE max({c}) OVER () - min({c}) OVER () END")))
def _(t):
    return rounded(S.min_max(base(t), [*COLS, "one"]))


@query("scale_maxabs", line(each("{c} / max(abs({c})) OVER ()")))
def _(t):
    return rounded(S.max_abs(base(t), [*COLS, "one"]))


@query("scale_standard", line(each("({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1.0 ELSE stddev_pop({c}) OVER () END")))
def _(t):
    return rounded(S.standard(base(t), [*COLS, "one"]))


@query("scale_robust", line(
    {c: f"({c} - {c}_q[2]) / CASE WHEN {c}_q[3] = {c}_q[1] THEN 1.0 ELSE {c}_q[3] - {c}_q[1] END" for c in (*COLS, "one")},
    f"({BASE}), (SELECT " + ", ".join(f"quantile_cont({c}, [0.25, 0.5, 0.75]) AS {c}_q" for c in (*COLS, "one")) + f" FROM ({BASE}))"))
def _(t):
    return rounded(S.robust(base(t), [*COLS, "one"]))


@query("scale_yeojohnson")
def _(t):
    return rounded(S.yeo_johnson(base(t), COLS))


@query("scale_boxcox")
def _(t):
    return rounded(S.box_cox(t.part.select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"]))


@query("scale_quantile_uniform", f"""
WITH q AS (SELECT i, i / 999.0::double AS p, v FROM (SELECT unnest(range(1000)) AS i, unnest(quantile_cont(l_quantity,
            [x / 999.0::double for x in range(1000)])) AS v FROM lineitem)),
x AS (SELECT DISTINCT l_quantity AS x FROM lineitem),
m AS (SELECT x, max(i) FILTER (WHERE v <= x) AS a, min(i) FILTER (WHERE v >= x) AS b FROM x, q GROUP BY x),
f AS (SELECT x, CASE WHEN ga.v = x THEN ga.p ELSE ga.p + (x - ga.v) * (gb.p - ga.p) / (gb.v - ga.v) END AS up,
             CASE WHEN gb.v = x THEN gb.p ELSE ga.p + (x - ga.v) * (gb.p - ga.p) / (gb.v - ga.v) END AS down,
             x = (SELECT min(v) FROM q) AS lowest, x = (SELECT max(v) FROM q) AS highest
      FROM m JOIN q ga ON ga.i = a JOIN q gb ON gb.i = b)
SELECT l_orderkey, l_linenumber, {sr('CASE WHEN lowest THEN 0.0 WHEN highest THEN 1.0 ELSE 0.5 * (up + down) END')} AS l_quantity
FROM lineitem JOIN f ON l_quantity = x""")
def _(t):
    return rounded(S.quantile(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), ["l_quantity"]))


@query("scale_quantile_normal")
def _(t):
    return rounded(S.quantile(base(t), COLS, output="normal"))
