"""Admission and counters over streams: keyed state that expires, and events that count once however often they are sent."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veilspark.functions import fixed

DAY = 24 * 60 * 60 * 1000


def once(events: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """events without those that repeat one of the same keys within ``late``, and without those that come later than that."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def admit_stream(files: DataFrame, queue: str, name: str, order: str, size: str, at: str, late: str = "10 minutes", max_file: int = fixed.MAX_FILE, max_queue: int = fixed.MAX_QUEUE, expiry: int = DAY) -> DataFrame:
    """(queue, id, reason) of a stream of files: what ``operators.control.admit`` gives if files come in order; files of one trigger
    are put in order. A file that is sent again within ``late`` counts once. A queue starts anew ``expiry`` milliseconds after
    its last file. State is one number for each queue; files of no queue are one."""
    def decide(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        used = state.get[0] if state.exists else 0
        pdf = pd.concat(list(rows)).sort_values(["position", "id"], kind="stable")
        reasons = []
        for n in pdf["bytes"].tolist():
            if n > max_file:
                reasons.append("file-too-large")
            elif used + n > max_queue:
                reasons.append("queue-total-exceeded")
            else:
                reasons.append(None)
                used += n
        state.update((used,))
        state.setTimeoutDuration(expiry)
        yield pd.DataFrame({"queue": [key[0]] * len(pdf), "id": pdf["id"].to_numpy(), "reason": pd.Series(reasons, dtype=object)})

    n = F.greatest(F.coalesce(F.col(size), F.lit(0)).cast("long"), F.lit(0).cast("long"))
    rows = once(files, [queue, name], at, late).select(F.coalesce(F.col(queue).cast("string"), F.lit("")).alias("queue"), F.col(name).cast("string").alias("id"), F.col(order).cast("long").alias("position"), n.alias("bytes"))
    return rows.groupBy("queue").applyInPandasWithState(decide, "queue string, id string, reason string", "bytes long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def count_stream(events: DataFrame, user: str, name: str, spans: str, at: str, late: str = "10 minutes", expiry: int = 30 * DAY) -> DataFrame:
    """(user, confirms, spans_masked), the totals of each user after each trigger that has events of theirs: each event confirms one
    mask and counts once, negative counts add nothing. Totals start anew ``expiry`` milliseconds after a user's last event."""
    def count(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        confirms, masked = state.get if state.exists else (0, 0)
        for pdf in rows:
            confirms, masked = confirms + len(pdf), masked + int(pdf["n"].sum())
        state.update((confirms, masked))
        state.setTimeoutDuration(expiry)
        yield pd.DataFrame({"user": [key[0]], "confirms": [confirms], "spans_masked": [masked]})

    n = F.greatest(F.coalesce(F.col(spans), F.lit(0)).cast("long"), F.lit(0).cast("long"))
    rows = once(events, [name], at, late).select(F.coalesce(F.col(user).cast("string"), F.lit("")).alias("user"), n.alias("n"))
    return rows.groupBy("user").applyInPandasWithState(count, "user string, confirms long, spans_masked long", "confirms long, spans long", "update", GroupStateTimeout.ProcessingTimeTimeout)
