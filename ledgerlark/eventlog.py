"""What a query did over all its jobs, from Spark's event log.

Run a query in a job group (``SparkContext.setJobGroup``) of a session with
``spark.eventLog.enabled``; ``totals`` then gives, per group, jobs, tasks, rows and bytes
read, bytes shuffled and spilled, task time and the longest task, and how often each
operator stands in the physical plans that ran, as adaptive execution left them.
Spooled steps count like the last one.
"""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict

OPERATORS = ("Exchange", "BroadcastExchange", "SortMergeJoin", "BroadcastHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct", "Window", "Expand")
PYTHON = re.compile(r"Python|Pandas|Arrow")
METRICS = {
    "rows read": "internal.metrics.input.recordsRead",
    "read": "internal.metrics.input.bytesRead",
    "shuffled": "internal.metrics.shuffle.write.bytesWritten",
    "spilled": "internal.metrics.diskBytesSpilled",
    "run ms": "internal.metrics.executorRunTime",
}


def _operators(plan: dict, into: Counter) -> None:
    name = plan["nodeName"]
    if name in OPERATORS:
        into[name] += 1
    elif PYTHON.search(name):
        into["Python"] += 1
    for child in plan["children"]:
        _operators(child, into)


def totals(log: str) -> dict[str, dict]:
    """Per job group of an event log: counts, summed metrics, operators of its plans."""
    group_of, found, plans, slices = {}, defaultdict(Counter), {}, defaultdict(list)
    with open(log) as lines:
        for event in map(json.loads, lines):
            kind = event["Event"].rsplit(".", 1)[-1]
            if kind == "SparkListenerJobStart":
                group = (event.get("Properties") or {}).get("spark.jobGroup.id")
                if group:
                    found[group]["jobs"] += 1
                    group_of |= {("stage", s): group for s in event["Stage IDs"]}
                    group_of["sql", int((event["Properties"]).get("spark.sql.execution.id") or -1)] = group
            elif kind == "SparkListenerStageCompleted":
                info = event["Stage Info"]
                if group := group_of.get(("stage", info["Stage ID"])):
                    found[group]["tasks"] += info["Number of Tasks"]
                    values = {a["Name"]: a["Value"] for a in info["Accumulables"]}
                    found[group].update({k: int(values.get(m, 0)) for k, m in METRICS.items()})
            elif kind == "SparkListenerTaskEnd" and event.get("Task Metrics"):
                if group := group_of.get(("stage", event["Stage ID"])):
                    slices[group, event["Stage ID"]].append(event["Task Metrics"]["Executor Run Time"])
            elif kind in ("SparkListenerSQLExecutionStart", "SparkListenerSQLAdaptiveExecutionUpdate"):
                plans[event["executionId"]] = event["sparkPlanInfo"]
    for execution, plan in plans.items():
        if group := group_of.get(("sql", execution)):
            _operators(plan, found[group])
    for (group, _), each in slices.items():
        found[group]["longest ms"] = max(found[group]["longest ms"], *each)
    return found
