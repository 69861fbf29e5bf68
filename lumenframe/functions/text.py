"""Text and JSON as column expressions: whole texts, no Python per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Start and end marks of chart blocks, and the mark around program output.
CHART_START = "<<<PLOTLY_START>>>"
CHART_END = "<<<PLOTLY_END>>>"

# Fixed value: elements kept from program output.
BLOCK_PATTERN = r"(?is)(<(?:table|h[1-6]|p|b|i|div|span|ul|ol|li)[^>]*?>.*?</(?:table|h[1-6]|p|b|i|div|span|ul|ol|li)>|<img[^>]+/?>)"

# Fixed value: fences around JSON in an answer.
FENCE_PATTERN = "```json|```"


def strip(c: Column) -> Column:
    """Remove white space, line ends included, at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def first_json(raw: Column) -> Column:
    """The first balanced ``{...}`` of a text with Python constants repaired; null when it is no JSON.

    Only runs between braces are walked, so long texts cost few steps.
    """
    begin = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("length"), F.lit(False).alias("closed"))

    def step(acc: Column, piece: Column) -> Column:
        depth = acc["depth"] + F.when(piece == "{", 1).when(piece == "}", -1).otherwise(0)
        moved = F.struct(
            depth.alias("depth"),
            (acc["length"] + F.length(piece)).alias("length"),
            ((piece == "}") & (depth == 0)).alias("closed"),
        )
        return F.when(acc["closed"], acc).otherwise(moved)

    def cut(tail: Column) -> Column:
        pieces = F.regexp_extract_all(tail, F.lit(r"[{}]|[^{}]+"), F.lit(0))
        return _once(
            F.aggregate(pieces, begin, step), lambda end: F.when(end["closed"], F.substr(tail, F.lit(1), end["length"]))
        )

    def valid(found: Column) -> Column:
        fixed = found
        for python, json in (("None", "null"), ("True", "true"), ("False", "false")):
            fixed = F.replace(fixed, F.lit(python), F.lit(json))
        return _once(fixed, lambda f: F.when(F.try_parse_json(f).isNotNull(), f))

    clean = strip(F.regexp_replace(raw, FENCE_PATTERN, ""))
    # Everything from the first brace on; null when there is none.
    tail = F.regexp_extract(clean, r"(?s)\{.*", 0)
    return _once(_once(F.nullif(tail, F.lit("")), cut), valid)


def _once(value: Column, use) -> Column:
    """Compute ``value`` once and use it under a name, however often ``use`` refers to it."""
    return F.transform(F.array(value), use)[0]


# Patterns of code in an answer, tried in this order.
CODE_PATTERNS = (
    r"(?s)```python\s*(.*?)```",
    r"(?s)```(.*?)```",
    r"(?s)((?:^|\n)(?:import |from |def |class ).*)",
)


def code_block(raw: Column) -> Column:
    """Code of a ``python`` fence, else of any fence, else from the first line that starts like code."""
    clean = strip(raw)
    tagged, fenced, bare = CODE_PATTERNS
    return (
        F.when(F.regexp_like(clean, F.lit(tagged)), strip(F.regexp_extract(clean, tagged, 1)))
        .when(F.regexp_like(clean, F.lit(fenced)), strip(F.regexp_extract(clean, fenced, 1)))
        .when(F.regexp_like(clean, F.lit(bare)), strip(F.regexp_extract(clean, bare, 1)))
    )


def marked_blocks(df: DataFrame, key: str, text: str, start: str = CHART_START, end: str = CHART_END) -> DataFrame:
    """``(key, block_no, block, error)``: text between the marks; a block that is no JSON carries an error."""
    found = F.regexp_extract_all(F.col(text), F.lit(f"(?s){start}(.*?){end}"), F.lit(1))
    blocks = df.select(key, F.posexplode(found).alias("block_no", "block"))
    block = strip(F.col("block"))
    return blocks.select(
        key,
        F.col("block_no").cast("long").alias("block_no"),
        block.alias("block"),
        F.when(F.try_parse_json(block).isNull(), F.lit("Invalid JSON")).alias("error"),
    )


def html_blocks(df: DataFrame, key: str, html: str) -> DataFrame:
    """``(key, block_no, block)``: tables, headings, paragraphs, lists and images in order."""
    found = F.regexp_extract_all(F.col(html), F.lit(BLOCK_PATTERN), F.lit(1))
    return df.select(key, F.posexplode(found).alias("no", "block")).select(
        key, F.col("no").cast("long").alias("block_no"), "block"
    )


def table_cells(df: DataFrame, key: str, html: str) -> DataFrame:
    """``(key, row_no, col_no, text)``: cells of the first table of each page, tags removed, trimmed."""
    table = F.regexp_extract(F.col(html), r"(?is)<table[^>]*>(.*?)</table>", 1)
    rows = F.regexp_extract_all(table, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = F.regexp_extract_all(F.col("row"), F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1))
    by_row = df.select(key, F.posexplode(rows).alias("row_no", "row"))
    by_cell = by_row.select(key, "row_no", F.posexplode(cells).alias("col_no", "cell"))
    return by_cell.select(
        key,
        F.col("row_no").cast("long").alias("row_no"),
        F.col("col_no").cast("long").alias("col_no"),
        strip(F.regexp_replace("cell", "<[^>]*>", "")).alias("text"),
    )


def file_extension(path: Column) -> Column:
    """Lower-case suffix of the last path part, without the dot."""
    return F.lower(F.regexp_extract(path, r"[^/.][.]([^./]+)$", 1))


def title_case(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def shorten(c: Column, n: int = 50) -> Column:
    return F.concat(F.left(c, F.lit(n)), F.lit("..."))


def fixed(c: Column, places: int = 4) -> Column:
    return F.format_string(f"%.{places}f", c.cast("double"))


def parse_number(text: Column) -> Column:
    """``(kind, number)``: int when the text is one, else float, else text without a number."""
    clean = strip(text)
    whole = F.when(F.regexp_like(clean, F.lit(r"^[+-]?[0-9]+$")), clean.try_cast("long"))
    real = clean.try_cast("double")
    kind = F.when(whole.isNotNull(), "int").when(real.isNotNull(), "float").when(text.isNotNull(), "text")
    return F.struct(kind.alias("kind"), F.coalesce(whole.cast("double"), real).alias("number"))


# Parameters that must be positive, those that must be positive whole numbers.
POSITIVE = ("C", "alpha", "learning_rate")
POSITIVE_WHOLE = ("n_estimators", "min_samples_split", "min_samples_leaf", "n_clusters")


def repair_parameter(name: Column, candidates: Column) -> Column:
    """``(value, text, changed)``: the first given candidate with impossible values put right.

    A bad positive number becomes 1, a bad count becomes 1, a bad depth means no limit. A parameter
    without these rules keeps its number, or its text.
    """
    raw = F.filter(candidates, lambda x: x.isNotNull())[0]
    parsed = parse_number(raw)
    number, kind = parsed["number"], parsed["kind"]
    bad_number = ~kind.isin("int", "float") | (number <= 0)
    bad_whole = (kind != "int") | (number <= 0)
    reset = F.when(name.isin(*POSITIVE) & bad_number, F.lit(True)).when(name.isin(*POSITIVE_WHOLE) & bad_whole, F.lit(True))
    unlimited = (name == "max_depth") & bad_whole
    value = F.when(reset, F.lit(1.0)).when(unlimited, F.lit(None)).otherwise(number)
    return F.when(
        raw.isNotNull(),
        F.struct(
            value.alias("value"),
            F.when(kind == "text", F.when(reset | unlimited, F.lit(None)).otherwise(raw)).alias("text"),
            F.coalesce(reset, F.lit(False)).__or__(F.coalesce(unlimited, F.lit(False))).alias("changed"),
        ),
    )


def nested_get(c: Column, outer: str, inner: str, default: Column) -> Column:
    """Lookup in a map of maps; a missing key at either level gives the default."""
    return F.coalesce(F.try_element_at(F.try_element_at(c, F.lit(outer)), F.lit(inner)), default)


def correlation_band(c: Column) -> Column:
    """Colour band of a correlation."""
    return (
        F.when(c == 1, "primary")
        .when(c >= 0.75, "accent")
        .when(c >= 0.5, "mid")
        .when(c > 0, "low")
        .when(c == 0, "zero")
        .when(c > -0.5, "cool")
        .when(c >= -0.75, "secondary")
        .when(c.isNotNull(), "secondary_dark")
    )
