"""Counters of one run: rows that passed named points, plan facts, and seconds, none of which is part of a result."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


class RunReport:
    def __init__(self, name: str):
        self.name, self.points, self.facts, self.seconds = name, {}, {}, 0.0

    def at(self, df: DataFrame, point: str) -> DataFrame:
        """Count rows as they pass here."""
        self.points[point] = seen = Observation(f"{self.name}.{point}")
        return df.observe(seen, F.count(F.lit(1)).alias("n_rows"))

    def run(self, df: DataFrame, action: Callable[[DataFrame], Any]) -> Any:
        """The action's result. The job group bears the report's name, so cancel() stops it from another thread."""
        context = df.sparkSession.sparkContext
        context.setJobGroup(self.name, self.name, interruptOnCancel=True)
        began = time.perf_counter()
        try:
            return action(df)
        finally:
            self.seconds = time.perf_counter() - began
            context.setLocalProperty("spark.jobGroup.id", None)
            self.facts = plan_facts(df)

    def cancel(self, df: DataFrame) -> None:
        df.sparkSession.sparkContext.cancelJobGroup(self.name)

    def rows(self) -> dict[str, int]:
        return {k: v.get["n_rows"] for k, v in self.points.items()}


def scan_metrics(df: DataFrame) -> dict[str, int]:
    """What the scans of a plan that has run (by collect(), say) have read: files, bytes of files, rows that left the scans."""
    out, todo = {"files": 0, "bytes": 0, "rows": 0}, [df._jdf.queryExecution().executedPlan()]
    names = {"numFiles": "files", "filesSize": "bytes", "numOutputRows": "rows"}
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if kind.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
        if kind.endswith("ScanExec"):
            for name, to in names.items():
                if node.metrics().contains(name):
                    out[to] += node.metrics().apply(name).value()
    return out


def plan_facts(df: DataFrame) -> dict[str, Any]:
    """What the physical plan says about pushdown, pruning, joins and shuffles."""
    conf, key = df.sparkSession.conf, "spark.sql.maxMetadataStringLength"
    told = conf.get(key)
    conf.set(key, 100_000)  # filters are cut off otherwise
    try:
        text = df._jdf.queryExecution().executedPlan().toString()
    finally:
        conf.set(key, told)
    return {
        "pushed": re.findall(r"PushedFilters: \[([^\]]*)\]", text),
        "partition_filters": re.findall(r"PartitionFilters: \[([^\]]*)\]", text),
        "read_schema": re.findall(r"ReadSchema: (\S+)", text),
        "broadcast_joins": len(re.findall(r"BroadcastHashJoin", text)),
        "shuffles": len(re.findall(r"(?<!Broadcast)Exchange (?:hash|range|Round|Single)", text)),
    }
