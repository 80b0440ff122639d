"""What is to be done next for each question: a state machine over a stream of attempts.

An id's state is its last attempt's number, the mode of the next call and how it ended, if it has. An answer that can't be read asks for one call in
plain mode, at once; a failure of the transport for another one in JSON mode after a wait, while tries are left; all else ends the id. The next start is a
timer in event time: when the watermark reaches it, the call is due. Attempts that come again, as after a restart, change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import ship

#: Calls in JSON mode, and seconds before one that follows a failure of the transport.
TRIES, WAIT = 11, 5

# Errors of answers that can't be read, statuses that end a whole run.
UNREAD, REFUSED = ("AnswerFormatError", "JSONDecodeError"), (401, 403)

STATE = "number int, mode string, outcome string, not_before long"
DECISION = "id string, attempt_number int, outcome string, next_mode string, not_before long, due boolean"


class Step(NamedTuple):
    """After attempt `number`: the next call's mode and earliest start in microseconds, or the outcome."""

    number: int
    mode: str | None
    outcome: str | None
    not_before: int | None


START = Step(0, "json", None, None)


def after(state: Step, number: int, status: str, http_status: int | None, error_type: str | None, retryable: bool, at: int, tries: int = TRIES, wait: int = WAIT) -> Step:
    """The state after an attempt that ended at `at`. A number that isn't new, or an id that has ended, stays as it is."""
    if state.outcome or number <= state.number:
        return state
    if status == "completed":
        return Step(number, None, "completed", None)
    if http_status in REFUSED:
        return Step(number, None, "refused", None)
    if state.mode == "json" and error_type in UNREAD:
        return Step(number, "plain", None, at)
    if state.mode == "json" and retryable and number < tries:
        return Step(number, "json", None, at + wait * 1_000_000)
    return Step(number, None, "failed", None)


def _maybe(value: object, kind: type) -> object:
    return None if pd.isna(value) else kind(value)


def decisions(attempts: DataFrame, tries: int = TRIES, wait: int = WAIT, lateness: str = "0 seconds") -> DataFrame:
    """(id, attempt_number, outcome, next_mode, not_before, due) for a stream of attempts(id, attempt_number, status, http_status, error_type, retryable, finished_at).

    A row for each id and batch with new attempts, as its state is then; and a row with `due` when the watermark has come to a call's earliest start.
    not_before: microseconds since 1970. Attempts without id, number or status don't count.
    """
    ship(attempts.sparkSession)

    def machine(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = Step(*state.get) if state.exists else START
        due = state.hasTimedOut
        if due:
            state.update(tuple(now._replace(not_before=None)))  # which also clears the timer
        else:
            new = now
            rows = sorted((r for f in frames for r in f.itertuples(index=False)), key=lambda r: (r.attempt_number, r.status))
            for r in rows:
                new = after(new, int(r.attempt_number), r.status, _maybe(r.http_status, int), _maybe(r.error_type, str), bool(_maybe(r.retryable, bool)), int(r.at), tries, wait)
            if new == now:
                return
            now = new
            state.update(tuple(now))
        waits = not due and now.not_before is not None
        if waits and now.not_before // 1000 > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(now.not_before // 1000)
            waits = False
        out = [(key[0], *now, False)] * (not due) + [(key[0], *now, True)] * (due or waits)
        made = pd.DataFrame([(i, n, o, m, b, d) for i, n, m, o, b, d in out], columns=["id", "attempt_number", "outcome", "next_mode", "not_before", "due"])
        yield made.astype({"attempt_number": "int32", "not_before": "Int64"})

    rows = attempts.withWatermark("finished_at", lateness).where("id is not null and attempt_number is not null and status is not null")
    rows = rows.select(F.col("id").cast("string").alias("id"), F.col("attempt_number").cast("int").alias("attempt_number"), "status", F.col("http_status").cast("int").alias("http_status"), "error_type", "retryable", "finished_at", F.unix_micros("finished_at").alias("at"))
    return rows.groupBy("id").applyInPandasWithState(machine, DECISION, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def next_calls(log: DataFrame) -> DataFrame:
    """The last decision of each id in a log of them: (id, attempt_number, outcome, next_mode, not_before)."""
    last = log.where("not due").groupBy("id").agg(F.max_by(F.struct("attempt_number", "outcome", "next_mode", "not_before"), "attempt_number").alias("d"))
    return last.select("id", "d.*")


def complete_cases(rows: DataFrame, parts: list[str], case: str = "case_id", part: str = "language") -> DataFrame:
    """(case_id, parts) from a stream of rows(case, part): each case once, in the batch that brings the last of its parts, whatever their order.

    The state of a case is a bit for each part and whether it has been given out. Other parts, repeated rows and rows without a case change nothing.
    """
    ship(rows.sparkSession)
    bits = {name: 1 << k for k, name in enumerate(parts)}
    whole = (1 << len(bits)) - 1

    def gate(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (seen,) = state.get if state.exists else (0,)
        if seen == whole:
            return
        new = seen
        for frame in frames:
            for name in frame["part"].unique():
                new |= bits.get(name, 0)
        if new != seen:
            state.update((new,))
        if new == whole:
            yield pd.DataFrame({"case_id": [key[0]], "parts": [len(bits)]})

    kind = rows.select(case).schema[0].dataType.simpleString()
    named = rows.where(F.col(case).isNotNull()).select(F.col(case).alias("case_id"), F.col(part).cast("string").alias("part"))
    return named.groupBy("case_id").applyInPandasWithState(gate, f"case_id {kind}, parts long", "seen long", "append", GroupStateTimeout.NoTimeout)


def run_to(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Everything that is there now, added to a folder of Parquet; a later call goes on where this one ended."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
