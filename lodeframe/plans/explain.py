"""EXPLAIN, EXPLAIN ANALYZE and EXPLAIN TRACE over Spark's own plans and metrics."""

from __future__ import annotations

import json
import time
from itertools import count

from pyspark.sql import DataFrame

LEVELS = ("SUMMARY", "NORMAL", "VERBOSE", "DEBUG")


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    jvm = df.sparkSession.sparkContext._jvm
    return df._jdf.queryExecution().explainString(jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def _node(plan, ids) -> dict:
    """One operator of an executed plan with its metrics; adaptive and query-stage wrappers are looked through."""
    name = plan.nodeName()
    inner = {"AdaptiveSparkPlan": "executedPlan", "ResultQueryStage": "plan", "ShuffleQueryStage": "plan", "BroadcastQueryStage": "plan", "TableCacheQueryStage": "plan"}.get(name)
    if inner:
        return _node(getattr(plan, inner)(), ids)
    metrics, it = {}, plan.metrics().iterator()
    while it.hasNext():
        pair = it.next()
        metrics[pair._1()] = pair._2().value()
    children, own = [], next(ids)
    kids = plan.children().iterator()
    while kids.hasNext():
        children.append(_node(kids.next(), ids))
    if name.startswith("WholeStageCodegen") or name == "InputAdapter":
        return children[0]
    stats = plan.logicalLink()
    estimate = None
    if stats.isDefined():
        rows = stats.get().stats().rowCount()
        estimate = int(str(rows.get())) if rows.isDefined() else None
    # what has no counterpart in Spark is null, not zero
    return {"node_id": own, "type": name, "estimated_rows": estimate, "cost": None, "actual_rows": metrics.get("numOutputRows"), "optimizer_note": None, "metrics": metrics, "children": children}


def run(df: DataFrame) -> int:
    """Execute the frame's own plan where the rows are, none of which reaches the driver; its metrics are filled then. Returns the rows."""
    return df._jdf.queryExecution().toRdd().count()


def _lines(node: dict, depth: int = 0) -> list[str]:
    told = {k: v for k, v in node["metrics"].items() if v and (k.lower().endswith("time") or k in ("spillSize", "dataSize"))}
    # a metric's time is in nanoseconds where its name says so
    ms = sum(v / 1e6 if k in ("shuffleWriteTime", "fetchWaitTime") else v for k, v in told.items() if k.lower().endswith("time"))
    rows = "" if node["actual_rows"] is None else f" rows={node['actual_rows']}"
    guess = "" if node["estimated_rows"] is None else f" estimated={node['estimated_rows']}"
    spilled = f" spilled={told['spillSize']}" if told.get("spillSize") else ""
    out = [f"{'  ' * depth}{node['type']}{rows}{guess} time={ms:.1f}ms{spilled}"]
    for child in node["children"]:
        out += _lines(child, depth + 1)
    return out


def analyze(df: DataFrame) -> tuple[str, int, float]:
    """The plan that ran as an indented tree with each operator's rows and time, the rows, and milliseconds."""
    start = time.perf_counter()
    rows = run(df)
    ms = (time.perf_counter() - start) * 1000
    return "\n".join(_lines(_node(df._jdf.queryExecution().executedPlan(), count(1)))), rows, ms


#: What each channel of a trace tells of an operator; a level below tells less.
CHANNELS = {"PLAN": ("estimated_rows", "cost", "optimizer_note"), "EXECUTOR": ("actual_rows",), "METRICS": ("metrics",)}


def trace(sql: str, df: DataFrame, built_us: float, level: str = "NORMAL", channels=None, events=None) -> str:
    """JSON report of one executed read: phases, operators with their rows, and the slowest ones."""
    if level not in LEVELS:
        raise ValueError(f"unknown level {level}")
    asked = {c.upper() for c in channels or ()} & set(CHANNELS)
    start = time.perf_counter()
    error, rows = None, 0
    try:
        rows = run(df)
    except Exception as e:  # the report says what failed
        error = str(e).splitlines()[0]
    executed = (time.perf_counter() - start) * 1e6
    plan = _node(df._jdf.queryExecution().executedPlan(), count(1))
    flat, todo = [], [plan]
    while todo:
        n = todo.pop()
        hidden = {k for c, keys in CHANNELS.items() if asked and c not in asked for k in keys} | ({"metrics"} if level in ("SUMMARY", "NORMAL") else set())
        flat.append({k: v for k, v in n.items() if k != "children"} | {"_hidden": hidden})
        todo += n["children"]
    flat.sort(key=lambda n: n["node_id"])
    slow = sorted(flat, key=lambda n: -sum(v for k, v in n["metrics"].items() if k.lower().endswith("time")))[:5]
    for n in flat:
        for k in n.pop("_hidden"):
            n.pop(k, None)
    report = {
        "format": "lodeframe.trace.v2",
        "trace": {"level": level, "channels": channels, "events_included": bool(events), "events_ref": events if isinstance(events, str) else None, "events_recorded": len(flat) if events else 0, "events_dropped": None},
        "query": {"sql": sql, "read_only": True},
        "pipeline": {"plan_us": built_us, "executor_create_us": None, "execute_us": executed, "actual_rows": rows},
        "error": error,
        "summary": {"operators": len(flat), "rows": rows},
        "hotspots": {"slowest_operators": [{"node_id": n["node_id"], "type": n["type"]} for n in slow]},
        "operators": flat,
    }
    if level != "SUMMARY":
        report["plan"] = plan
    if events is True:
        report["events"] = [{"node_id": n["node_id"], "event": "finished", "rows": n["actual_rows"]} for n in flat]
    return json.dumps(report, indent=1, default=str)
