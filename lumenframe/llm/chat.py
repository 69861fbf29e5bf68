"""Multi-party perspective rotation of conversations, in DataFrame functions only.

For every speaker of a conversation the whole dialogue is rendered once with that speaker as ``assistant`` and
the others as named users; a loss mask covers what the assistant says. A rendered dialogue is delivered message by
message: ``rendered`` in the order of ``position`` is the dialogue, ``start`` and ``end`` are the place of the message
in it (in characters), ``mask_start`` and ``mask_end`` the trained part. So no conversation has to fit in one row or
one task: places come from prefix sums over chunks of turns and then within a chunk.

Defined cases: null or empty text renders an empty message; a null role is a speaker named ``unknown``; names keep
letters, digits, ``_`` and ``-``, other characters become ``_`` (two speakers whose names become equal stay different
perspectives); roles in ``instructions`` (``system``) are no speakers and keep their role; a conversation of
instructions only has no perspective; equal turns are ordered by role and text; a null turn comes first; rows with a
null conversation id form one conversation. Repeated rows are repeated messages. Other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Turns of one chunk of the prefix sums.
CHUNK = 1024


def perspectives(df: DataFrame, instructions: tuple[str, ...] = ("system",), chunk: int = CHUNK) -> DataFrame:
    """``conv_id, perspective, position, turn, role, name, rendered, start, end, mask_start, mask_end`` of ``df(conv_id, turn, role, text)``."""
    role = F.coalesce(F.col("role"), F.lit("unknown"))
    rows = df.select(
        "conv_id", "turn", role.alias("speaker"), F.coalesce("text", F.lit("")).alias("text"),
        F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / chunk).cast("long").alias("chunk"),
        role.isin(*instructions).alias("instruction"),
    )
    # Distinct speakers are few next to messages; partial aggregation removes repeats before the shuffle.
    speakers = rows.where(~F.col("instruction")).select(
        F.col("conv_id").alias("of"), F.col("speaker").alias("perspective")
    ).distinct()
    each = rows.join(speakers, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    name = F.regexp_replace("speaker", "[^A-Za-z0-9_-]", "_")
    own = ~F.col("instruction") & (F.col("speaker") == F.col("perspective"))
    shown = F.when(F.col("instruction"), F.col("speaker")).when(own, F.lit("assistant")).otherwise(F.lit("user"))
    head = F.concat(F.lit(OPEN), shown, F.when(F.col("instruction") | own, F.lit("")).otherwise(F.concat(F.lit(" name="), name)), F.lit("\n"))
    parts = each.select(
        "conv_id", "perspective", "chunk", "turn", "speaker", "text", shown.alias("role"),
        F.when(F.col("instruction") | own, F.lit(None).cast("string")).otherwise(name).alias("name"), own.alias("own"),
        F.concat(head, F.col("text"), F.lit(CLOSE)).alias("rendered"), F.length(head).cast("long").alias("head"),
    ).withColumn("size", F.length("rendered").cast("long"))
    key = ["conv_id", "perspective"]
    totals = parts.groupBy(*key, "chunk").agg(F.sum("size").alias("chars"), F.count("*").alias("messages"))
    before = Window.partitionBy(*key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(c).alias(f"at_{c}") for c in (*key, "chunk")],
        F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars_before"),
        F.coalesce(F.sum("messages").over(before), F.lit(0)).alias("messages_before"),
    )
    same = F.lit(True)
    for c in (*key, "chunk"):
        same = same & F.col(c).eqNullSafe(F.col(f"at_{c}"))
    order = [F.col("turn").asc_nulls_first(), F.col("speaker"), F.col("text")]
    inner = Window.partitionBy(*key, "chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    number = Window.partitionBy(*key, "chunk").orderBy(*order)
    placed = parts.withColumn("within", F.coalesce(F.sum("size").over(inner), F.lit(0))).withColumn("row", F.row_number().over(number))
    joined = placed.join(offsets, same)
    start = F.col("chars_before") + F.col("within")
    return joined.select(
        "conv_id", "perspective", (F.col("messages_before") + F.col("row") - 1).alias("position"), "turn", "role", "name", "rendered",
        start.alias("start"), (start + F.col("size")).alias("end"),
        F.when(F.col("own"), start + F.col("head")).alias("mask_start"), F.when(F.col("own"), start + F.col("size")).alias("mask_end"),
    )


def oracle(table: str = "conversations") -> str:
    """The same rows in SQL."""
    return f"""
WITH m AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM {table}),
s AS (SELECT DISTINCT conv_id AS c, speaker AS perspective FROM m WHERE speaker <> 'system'),
j AS (SELECT m.*, s.perspective, m.speaker = s.perspective AS own, m.speaker = 'system' AS ins,
 regexp_replace(m.speaker, '[^A-Za-z0-9_-]', '_', 'g') AS who FROM m JOIN s ON m.conv_id IS NOT DISTINCT FROM s.c),
h AS (SELECT *, CASE WHEN ins THEN speaker WHEN own THEN 'assistant' ELSE 'user' END AS role,
 CASE WHEN ins OR own THEN NULL ELSE who END AS name FROM j),
p AS (SELECT *, '{OPEN}' || role || coalesce(' name=' || name, '') || chr(10) AS head FROM h),
r AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS rendered FROM p),
o AS (SELECT *, row_number() OVER w - 1 AS position, sum(length(rendered)) OVER w AS stop FROM r
 WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, position, turn, role, name, rendered, (stop - length(rendered))::bigint AS start, stop::bigint AS "end",
 CASE WHEN own THEN (stop - length(rendered) + length(head))::bigint END AS mask_start, CASE WHEN own THEN stop::bigint END AS mask_end
FROM o"""
