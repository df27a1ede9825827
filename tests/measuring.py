"""What Spark counted while a query ran."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def most_rows(df: DataFrame) -> int:
    """The most rows that any operator of the plan gave when df was collected."""
    session = df.sparkSession
    df.collect()
    session.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store = session._jsparkSession.sharedState().statusStore()
    last = max((e.executionId() for e in _items(store.executionsList())))
    values = store.executionMetrics(last)
    found = [0]
    for node in _items(store.planGraph(last).allNodes()):
        for metric in _items(node.metrics()):
            if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                found.append(int(re.sub(r"\D", "", values.apply(metric.accumulatorId()).split("\n")[-1].split("(")[0]) or 0))
    return max(found)


def _items(seq) -> list:
    return [seq.apply(k) for k in range(seq.size())]
