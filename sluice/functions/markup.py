"""Text of Markdown and JSON files (SRC5 beside ``html``).

``markdown_to_text`` is a chain of regular expressions, each read once over the
text. ``json_to_text`` parses into VARIANT and walks the tree a level at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.session import write_table

FENCE = r"(?m)^ {0,3}(?:```|~~~)[^\n]*$"
BREAK = "\x01"          # stands between blocks while lines are joined

# Fixed values: (pattern, replacement) for the text outside of code fences, in order.
MARKS = [
    ("\r\n?", "\n"),
    (BREAK, " "),
    (r"(?m)^ {0,3}[-*_][ \t]*[-*_][ \t]*[-*_][-*_ \t]*$", ""),                   # rules
    (r"(?m)^[ \t]{0,3}>[> \t]*", ""),                           # quotes
    (r"(?m)^ {0,3}#{1,6}[ \t]+([^\n]*)$", "\n\n$1\n\n"),        # headings
    (r"(?m)^[ \t]*(?:[-*+]|[0-9]{1,9}[.)])[ \t]+", "\n\n"),     # list items
    (r"!?\[([^\]\n]*)\]\([^)\n]*\)", "$1"),                     # images and links
    (r"\*\*([^*\n]+)\*\*", "$1"),
    (r"__([^_\n]+)__", "$1"),
    (r"\*([^* \t\n][^*\n]*)\*", "$1"),
    (r"`([^`\n]+)`", "$1"),
    (r"[ \t]+", " "),
    (r" ?\n ?", "\n"),
    (r"\n\n+", BREAK),
    (r"\n", " "),
    (BREAK, "\n"),
    (r"^[ \n]+|[ \n]+$", ""),
]


def markdown_to_text(text: Column | str) -> Column:
    """SRC5: Markdown to one line per block (heading, paragraph, list item).
    Fences cut the text; every second piece is code and keeps its lines. Marks of
    headings, lists, quotes, rules, links, images and emphasis go."""
    c = F.col(text) if isinstance(text, str) else text

    def piece(p: Column, i: Column) -> Column:
        plain = p
        for pattern, to in MARKS:
            plain = F.regexp_replace(plain, F.lit(pattern), F.lit(to))
        return F.when(i % 2 == 0, plain).otherwise(F.regexp_replace(p, r"^\n|\n$", ""))
    pieces = F.transform(F.split(c, FENCE, -1), piece)
    return F.when(c.isNotNull(), F.array_join(F.filter(pieces, lambda p: p != ""), "\n"))


def json_to_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """SRC5: (<id>, text): strings, numbers and booleans of a JSON text, one per
    line: list members in order, object members by name, nulls left out. A text
    that is no JSON comes out as it is; null text as null.

    A level of the tree is one pass over the containers that are left, from
    written tables; the lines of a text meet by (row, path)."""
    spark = df.sparkSession
    rows = write_table(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("raw"))
                       .withColumn("row", F.monotonically_increasing_id()), "json-rows")
    nodes = rows.select("row", F.array().cast("array<int>").alias("path"),
                        F.try_parse_json("raw").alias("v")).filter("v IS NOT NULL")
    leaves = []
    while True:
        kind = F.schema_of_variant("v")
        nodes = write_table(nodes.withColumn("inner", kind.startswith("OBJECT") | kind.startswith("ARRAY")), "json-nodes")
        leaves.append(nodes.filter(~F.col("inner")).select("row", "path", F.col("v").cast("string").alias("line")))
        deeper = nodes.filter("inner")
        if deeper.isEmpty():
            break
        deeper.createOrReplaceTempView("sluice_json_nodes")
        nodes = spark.sql("SELECT row, concat(path, array(t.pos)) AS path, t.value AS v "
                          "FROM sluice_json_nodes, LATERAL variant_explode(v) AS t")
    lines = leaves[0]
    for more in leaves[1:]:
        lines = lines.unionByName(more)
    text = (lines.filter("line IS NOT NULL").groupBy("row")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "line"))), lambda x: x["line"]), "\n")
                 .alias("text")))
    parsed = F.try_parse_json("raw").isNotNull()
    return (rows.join(text, "row", "left")
            .select(F.col("id").alias(id_col), F.when(parsed, F.coalesce("text", F.lit(""))).otherwise(F.col("raw")).alias("text")))
