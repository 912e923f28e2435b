"""Plans without side effects: what a query would read and shuffle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def dry_run(frame: DataFrame) -> dict:
    """Scans with their columns and pushed filters, and how many exchanges, joins and Python stages a plan holds."""
    text = frame._jdf.queryExecution().explainString(frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    tree = text.split("\n\n\n")[0]
    scans = []
    for block in map(str.strip, re.split(r"\n\s*\n", text)):
        if re.match(r"\(\d+\) Scan ", block):
            columns = re.search(r"ReadSchema: struct<(.*?)>\s*$", block, re.MULTILINE)
            filters = re.search(r"PushedFilters: \[(.*?)\]\s*$", block, re.MULTILINE)
            scans.append({"columns": re.findall(r"(\w+):", columns[1]) if columns else [], "filters": filters[1] if filters else ""})
    count = lambda pattern: len(re.findall(pattern, tree))
    return {
        "scans": scans,
        "exchanges": count(r"(?<!Broadcast)Exchange \("),
        "broadcasts": count(r"BroadcastExchange"),
        "joins": count(r"Join"),
        "python": count(r"InArrow|InPandas|ArrowEval|BatchEvalPython"),
        "cartesian": count(r"CartesianProduct|BroadcastNestedLoopJoin"),
    }
