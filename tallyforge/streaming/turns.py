"""Interaction turns as a stream: attempts are judged as they arrive, with one small state per task."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calls as C


def judged_turns(turns: DataFrame, in_order: bool = False, most: int = 20) -> DataFrame:
    """(task, n, verdict, solved_at): a row for each attempt of a stream of turns (task, n, agent_text, solution: array of calls).

    The state of a task is its number of turns and the turn that solved it; turns after that, or after the first most, are not judged. A
    task's turns must arrive in order.
    """

    def judge(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen, solved = state.get if state.exists else (0, -1)
        out = []
        for part in parts:
            for turn in part.sort_values("n").itertuples():
                if solved >= 0 or seen >= most:
                    continue
                seen += 1
                for attempt in C.attempts(turn.agent_text):
                    if C.extraneous(attempt):
                        verdict = "extraneous"
                    else:
                        verdict = "correct" if C.verified(C.all_calls(attempt), list(turn.solution), in_order) else "wrong"
                    solved = turn.n if verdict == "correct" else solved
                    out.append((key[0], turn.n, verdict, solved if solved >= 0 else None))
        state.update((seen, solved))
        yield pd.DataFrame(out, columns=["task", "n", "verdict", "solved_at"]).astype({"n": "int64", "solved_at": "Int64"})

    return turns.groupBy("task").applyInPandasWithState(judge, "task string, n long, verdict string, solved_at long", "seen long, solved long", "append", "NoTimeout")


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, kind, n): events in windows of a width; events later than the watermark are dropped."""
    counted = events.withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), kind, "n")
