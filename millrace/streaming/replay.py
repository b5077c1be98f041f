"""Event streams: history and live, replay-safe dedupe, last states, terminal gates, state machines."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def event_key(id_: Column, kind: Column, at: Column) -> Column:
    """The id, or a hash of kind and time where it is empty: two events without an id stay two."""
    return F.coalesce(F.nullif(id_, F.lit("")), F.sha2(F.concat_ws("|", kind, at.cast("string")), 256))


def merge_history(history: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """History and live events, each key once, history first; `live` is 0 or 1."""
    both = history.withColumn("live", F.lit(0)).unionByName(live.withColumn("live", F.lit(1)))
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("live"))).where("_n = 1").drop("_n")


def terminal(kind: Column, reason: Column) -> Column:
    """Terminated, or idle for another reason than a required action."""
    return (kind == "terminated") | ((kind == "idle") & (F.coalesce(reason, F.lit("")) != "requires_action"))


def last_state(events: DataFrame, key: str, processed: str) -> DataFrame:
    """A key's processed state where it has one, else its queued one."""
    one = Window.partitionBy(key).orderBy(F.col(processed).desc_nulls_last())
    return events.withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n")


def dedupe_stream(events: DataFrame, key: str, time: str, late: str = "10 minutes") -> DataFrame:
    """At-least-once delivery made exactly-once within the watermark; works on batches too."""
    if not events.isStreaming:
        return events.dropDuplicates([key])
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


class Machine:
    """waiting -> pending at a candidate that is accepted -> yes or no.

    A candidate that is not accepted, and a stop while waiting, decide for no. The body of a pending candidate follows
    in pieces. Without a needle a stop then decides for yes; with one, the body does: yes as soon as it holds the
    needle, no at a stop before. Events after the decision change nothing. Of the body only its length and what a
    needle may still begin in are kept.
    """

    def __init__(self, candidate: str, stops: list[str], needle: str | None) -> None:
        self.candidate, self.stops, self.needle = candidate, set(stops), needle

    def step(self, state: tuple[str, int, str], what: str, body: str, accepted: bool) -> tuple[str, int, str]:
        name, n, tail = state
        if name in ("yes", "no"):
            return state
        if what == self.candidate:
            if not accepted:
                return "no", n, ""
            name, n, tail = "pending", 0, ""
        elif what in self.stops:
            return ("yes" if name == "pending" and self.needle is None else "no"), n, ""
        elif name == "waiting":
            return state
        n, tail = n + len(body), tail + body
        if self.needle is not None and self.needle in tail:
            return "yes", n, ""
        return name, n, tail[-max(0, len(self.needle) - 1) :] if self.needle and len(self.needle) > 1 else ""


SAID = {"yes": "accepted", "no": "rejected"}


def decide(events: DataFrame, key: str, order: str, kind: str, candidate: str, body: str, accept: Column, stops: list[str], needle: str | None = None) -> DataFrame:
    """(key, decision, gathered) by the state machine over each key's events in order; gathered is the length of the last body.

    Keys are folded as streams of sorted rows, so a key of any length needs the memory of one batch.
    """
    from millrace.operators.sequence import fold_sorted

    machine = Machine(candidate, stops, needle)
    rows = events.select(key, order, F.col(kind).alias("_k"), F.coalesce(F.col(body), F.lit("")).alias("_b"), F.coalesce(accept, F.lit(False)).alias("_a"))

    def step(state, frame):
        state = state or ("waiting", 0, "")
        for what, piece, accepted in zip(frame["_k"], frame["_b"], frame["_a"], strict=True):
            state = machine.step(state, what, piece, accepted)
        return state

    kinds = dict(events.dtypes)
    return fold_sorted(rows, [key], [order], step, lambda k, state: [(*k, SAID.get(state[0], "open"), state[1])], f"{key} {kinds[key]}, decision string, gathered int")


def decide_stream(events: DataFrame, key: str, order: str, kind: str, candidate: str, body: str, accept: Column, stops: list[str], needle: str | None = None, timeout_ms: int | None = 30_000) -> DataFrame:
    """The same machine over a stream: (key, decision, gathered), one row when a key is decided or its time (None: no limit) is out.

    Within a micro-batch a key's events are taken in order; its state goes on from batch to batch.
    """
    import pandas as pd

    machine = Machine(candidate, stops, needle)
    rows = events.select(key, order, F.col(kind).alias("_k"), F.coalesce(F.col(body), F.lit("")).alias("_b"), F.coalesce(accept, F.lit(False)).alias("_a"))
    names = [key, "decision", "gathered"]

    def run(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else ("waiting", 0, "")
        if state.hasTimedOut:
            state.remove()
            if now[0] not in SAID:
                yield pd.DataFrame([(k[0], "timeout", now[1])], columns=names)
            return
        done = now[0] in SAID
        for what, piece, accepted in pd.concat(list(frames)).sort_values(order)[["_k", "_b", "_a"]].itertuples(index=False):
            now = machine.step(now, what, piece, accepted)
        state.update(now)
        if now[0] in SAID:
            if not done:
                yield pd.DataFrame([(k[0], SAID[now[0]], now[1])], columns=names)
        elif timeout_ms is not None:
            state.setTimeoutDuration(timeout_ms)

    schema = f"{key} {dict(events.dtypes)[key]}, decision string, gathered int"
    return rows.groupBy(key).applyInPandasWithState(run, schema, "name string, gathered int, tail string", "append", "NoTimeout" if timeout_ms is None else "ProcessingTimeTimeout")


def first_tool_block(content: Column, tools: dict[str, str], needle: str) -> Column:
    """Whether the first tool_use block of a message (an array of type, name, input: a map) names the needle in its tool's field.

    tools: the field of each tool that counts. Later blocks do not matter; null if there is no tool_use block.
    """
    first = F.try_element_at(F.filter(content, lambda c: c["type"] == "tool_use"), F.lit(1))
    hit = F.lit(False)
    for name, field in tools.items():
        hit = hit | ((first["name"] == name) & F.coalesce(F.contains(F.try_element_at(first["input"], F.lit(field)), F.lit(needle)), F.lit(False)))
    return F.when(first.isNotNull(), hit)
