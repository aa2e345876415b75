"""Plug-in surface (U1-U7): named actions backed by column functions or
pandas UDFs, metric declarations turned into aggregations, model hooks on
Arrow batches, a SELECT-only SQL action, write statements, custom safety
rules, and the links table function.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.session import write_table


# ------------------------------------------------------------------- U1 ---
@dataclass
class Action:
    name: str
    fn: Callable[..., Column]
    doc: str = ""
    params: dict = field(default_factory=dict)


class PluginRegistry:
    """Plug-ins with named actions. An action is a function returning a
    Column (a built-in expression or a pandas UDF), so executing it is a
    projection on the executors. Unknown actions raise."""

    def __init__(self):
        self.plugins: dict[str, dict[str, Action]] = {}

    def register_action(self, plugin: str, name: str, fn: Callable[..., Column],
                        doc: str = "", **defaults) -> None:
        self.plugins.setdefault(plugin, {})[name] = Action(name, fn, doc or (fn.__doc__ or ""), defaults)

    def actions(self, plugin: str) -> list[dict]:
        """Introspection: name, doc, params with defaults."""
        return [{"name": a.name, "doc": a.doc.strip(), "params": dict(a.params)}
                for a in self.plugins.get(plugin, {}).values()]

    def execute(self, df: DataFrame, plugin: str, action: str, out: str = "result",
                **params) -> DataFrame:
        """Adds struct(success, result, error, ms) -- ``ms`` is the planning
        time of the action (per-row timing has no meaning in a projection)."""
        acts = self.plugins.get(plugin)
        if not acts or action not in acts:
            raise KeyError(f"unknown action {plugin}.{action}")
        a = acts[action]
        t0 = time.time()
        col = a.fn(**{**a.params, **params})
        ms = (time.time() - t0) * 1000.0
        return df.withColumn(out, F.struct(col.isNotNull().alias("success"), col.alias("result"),
                                           F.when(col.isNull(), F.lit("null result")).alias("error"),
                                           F.lit(ms).alias("ms")))


# ------------------------------------------------------------------- U2 ---
def metric_aggregate(df: DataFrame, spec: dict) -> DataFrame:
    """A metric declaration (counter / gauge / histogram / summary with
    labels, buckets, quantiles) turned into its aggregation."""
    from sluice.operators import usage as us
    kind, labels = spec["type"], spec.get("labels", [])
    value = spec.get("value", "value")
    if kind == "counter":
        return us.counter(df, labels, spec.get("amount"))
    if kind == "gauge":
        return us.gauge_latest(df, labels, value, spec.get("ts", "ts"))
    if kind == "histogram":
        return us.histogram(df, value, labels, spec.get("buckets") or us.DEFAULT_BUCKETS)
    if kind == "summary":
        return us.summary(df, value, labels, spec.get("quantiles") or us.DEFAULT_QUANTILES)
    raise ValueError(f"unknown metric type {kind}")


# ------------------------------------------------------------------- U3 ---
def model_hook(fn: Callable[[pd.Series], pd.Series], return_type: T.DataType | str):
    """Wrap a batch model (embedder, PII analyser, reranker) taking a
    pandas Series and returning one value per row, as an Arrow-batched UDF."""
    return F.pandas_udf(fn, return_type)


# ------------------------------------------------------------- U4, U5 ---
def writes(spark: SparkSession, sql: str) -> bool:
    """Whether the parsed statement holds a command or a write anywhere (also
    behind WITH). Nothing is analysed or run."""
    logical = "org.apache.spark.sql.catalyst.plans.logical."
    find = spark._jvm.java.lang.Class.forName
    kinds = [find(logical + "Command"), find(logical + "ParsedStatement")]
    todo = [spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)]
    while todo:
        node = todo.pop()
        if any(k.isInstance(node) for k in kinds):
            return True
        for many in (node.children(), node.innerChildren()):
            todo += [many.apply(i) for i in range(many.size())
                     if find(logical + "LogicalPlan").isInstance(many.apply(i))]
    return False


def sql_query(spark: SparkSession, sql: str, args: dict | None = None,
              max_rows: int | None = None) -> DataFrame:
    """U4: parameterised read-only query. All rows are returned unless the
    caller sets ``max_rows``; then the column ``truncated`` tells whether rows
    were cut. Statements that write are refused from their parsed plan."""
    if writes(spark, sql):
        raise ValueError("only SELECT / WITH / VALUES statements are allowed")
    out = spark.sql(sql, args=args or {})
    if max_rows is None:
        return out
    some = out.limit(max_rows + 1)
    total = some.agg(F.count("*").alias("_n"))
    return (some.limit(max_rows).join(F.broadcast(total))
            .withColumn("truncated", F.col("_n") > max_rows).drop("_n"))


def sql_execute(spark: SparkSession, target: str, rows: DataFrame, mode: str = "append") -> int:
    """Write statement as a DataFrame write (INSERT INTO / CTAS);
    affected rows = rows written. The rows are computed once. Plain Parquet
    has no UPDATE/DELETE."""
    rows = write_table(rows, "sql-execute")
    n = rows.count()
    if mode == "insert":
        rows.write.insertInto(target)
    else:
        rows.write.mode(mode).saveAsTable(target)
    return n


# ------------------------------------------------------------------- U6 ---
def custom_rule(name: str, pattern: str, weight_tenths: int, blocks: bool):
    """A user rule for ``content_risk(custom_rules=...)``."""
    def make(text: Column):
        return (name, text.rlike("(?i)" + pattern), weight_tenths, blocks)
    return make


# ------------------------------------------------------------------- U7 ---
def links_udtf():
    """F34 as a Python table function (one row per link), usable with
    LATERAL in SQL after ``spark.udtf.register``."""
    from pyspark.sql.functions import udtf

    from sluice.functions.html import LINK
    pat = re.compile(LINK[len("(?is)"):], re.IGNORECASE | re.DOTALL)

    @udtf(returnType="pos: int, text: string, href: string")
    class Links:
        def eval(self, html: str):
            if html is None:
                return
            for i, m in enumerate(pat.finditer(html)):
                yield i, m.group(2), m.group(1)

    return Links
