"""Totals per job group from a hand-made event log."""

import json

from ledgerlark.eventlog import totals


def _stage(number, tasks, **metrics):
    names = {"rows": "internal.metrics.input.recordsRead", "shuffled": "internal.metrics.shuffle.write.bytesWritten", "ms": "internal.metrics.executorRunTime"}
    return {"Event": "SparkListenerStageCompleted", "Stage Info": {"Stage ID": number, "Number of Tasks": tasks, "Accumulables": [{"Name": names[k], "Value": v} for k, v in metrics.items()]}}


def _job(group, execution, *stages):
    return {"Event": "SparkListenerJobStart", "Stage IDs": list(stages), "Properties": {"spark.jobGroup.id": group, "spark.sql.execution.id": str(execution)} if group else None}


def _plan(name, *children):
    return {"nodeName": name, "children": list(children)}


def test_totals(tmp_path):
    sql = "org.apache.spark.sql.execution.ui."
    events = [
        {"Event": sql + "SparkListenerSQLExecutionStart", "executionId": 7, "sparkPlanInfo": _plan("SortMergeJoin", _plan("Exchange"), _plan("Exchange"))},
        _job("a", 7, 0, 1),
        _stage(0, 4, rows=100, shuffled=50, ms=40),
        {"Event": "SparkListenerTaskEnd", "Stage ID": 0, "Task Metrics": {"Executor Run Time": 9}},
        {"Event": "SparkListenerTaskEnd", "Stage ID": 0, "Task Metrics": {"Executor Run Time": 31}},
        _stage(1, 2, ms=5),
        {"Event": sql + "SparkListenerSQLAdaptiveExecutionUpdate", "executionId": 7, "sparkPlanInfo": _plan("BroadcastHashJoin", _plan("ArrowEvalPython"), _plan("BroadcastExchange"))},
        _job("a", 8, 2),
        _stage(2, 1, rows=3),
        _job("b", 9, 3),
        _stage(3, 1, rows=8),
        _job(None, 0, 4),
        _stage(4, 9, rows=999),
    ]
    log = tmp_path / "log"
    log.write_text("".join(json.dumps(e) + "\n" for e in events))
    got = totals(str(log))
    assert set(got) == {"a", "b"}
    a = got["a"]
    assert (a["jobs"], a["tasks"], a["rows read"], a["shuffled"], a["run ms"], a["longest ms"]) == (2, 7, 103, 50, 45, 31)
    # the plan as adaptive execution left it
    assert (a["BroadcastHashJoin"], a["BroadcastExchange"], a["Python"], a["SortMergeJoin"], a["Exchange"]) == (1, 1, 1, 0, 0)
    assert got["b"]["rows read"] == 8
