"""Conversation sessions as keyed state: what each session refers to, what waits for approval, how often it asked back.

A log of events becomes the state of each session after each event. ``live`` keeps the state of a stream by
``transformWithState``; ``replay`` gives the same rows of a finished log, by windows. Events of a session come in the order
of ``seq``, in one batch or in many.

Events: session_id, seq, at, kind, and the columns of TURN. Kinds: ``turn`` replaces the record (its clarifications too,
pending batches stay), ``clarified`` counts one more question back, ``answered`` sets that count to 0; either makes a
record, of protocol ``llm``, where there is none. ``submitted`` and ``finished`` add and remove a pending ``batch``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What a turn tells.
TURN = {
    "intent": "string", "scope": "string", "protocol": "string", "referent_count": "long", "referent_query": "string", "referent_field": "string", "referent_value": "string",
    "mutation_required": "boolean", "clarifications": "long",
}
EVENT = {"session_id": "string", "seq": "long", "at": "string", "kind": "string", "batch": "string"} | TURN
RECORD = TURN | {"created_at": "string", "updated_at": "string", "pending": "array<string>"}
OUTPUT = {"session_id": "string", "seq": "long"} | RECORD
#: Fixed value: the protocol of a record that a question back or an answer makes.
BY_MODEL = "llm"


def _schema(columns: dict[str, str]) -> str:
    return ", ".join(f"{c} {t}" for c, t in columns.items())


def advance(record: dict | None, event: dict) -> dict:
    """The record after an event."""
    new = dict(record) if record else dict.fromkeys(RECORD) | {"pending": [], "protocol": BY_MODEL, "clarifications": 0, "created_at": event["at"]}
    if event["kind"] == "turn":
        new |= {c: event[c] for c in TURN}
    elif event["kind"] == "clarified":
        new["clarifications"] = (new["clarifications"] or 0) + 1
    elif event["kind"] == "answered":
        new["clarifications"] = 0
    elif event["kind"] == "submitted" and event["batch"] not in new["pending"]:
        new["pending"] = [*new["pending"], event["batch"]]
    elif event["kind"] == "finished":
        new["pending"] = [b for b in new["pending"] if b != event["batch"]]
    return new | {"updated_at": event["at"]}


def _plain(value: object, kind: str) -> object:
    """A value out of pandas or of state, with null for what lacks; pandas holds longs beside nulls as doubles."""
    if kind.startswith("array"):
        return [str(v) for v in value]
    return None if pd.isna(value) else {"long": int, "boolean": bool}.get(kind, str)(value)


class Sessions(StatefulProcessor):
    """The record of each session; nothing else is kept of its events."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.record = handle.getValueState("record", _schema(RECORD))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values("seq", kind="stable")
        record = dict(zip(RECORD, map(_plain, self.record.get(), RECORD.values()))) if self.record.exists() else None
        out = []
        for event in events.to_dict("records"):
            event = {c: _plain(event[c], kind) for c, kind in EVENT.items()}
            record = advance(record, event)
            out.append((key[0], event["seq"], *record.values()))
        self.record.update(tuple(record[c] for c in RECORD))
        frame = pd.DataFrame(out, columns=list(OUTPUT))
        yield frame.astype({"mutation_required": "boolean", "referent_count": "Int64", "clarifications": "Int64"})

    def close(self) -> None:
        pass


def live(events: DataFrame) -> DataFrame:
    """The stream of records after each event of the stream ``events``."""
    typed = events.select(*[F.col(c).cast(t).alias(c) for c, t in EVENT.items()])
    return typed.groupBy("session_id").transformWithStateInPandas(Sessions(), _schema(OUTPUT), "Append", "None")


def replay(events: DataFrame) -> DataFrame:
    """The records after each event of a finished log."""
    so_far = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    kind = F.col("kind")
    told = F.last(F.when(kind == "turn", F.struct(*TURN)), ignorenulls=True).over(so_far)
    # Clarifications count on from the last turn or answer.
    base = F.last(F.when(kind == "turn", F.coalesce("clarifications", F.lit(0))).when(kind == "answered", 0), ignorenulls=True).over(so_far)
    started = F.sum(F.when(kind.isin("turn", "answered"), 1).otherwise(0)).over(so_far)
    rows = events.withColumns({"_told": told, "_base": F.coalesce(base, F.lit(0)), "_island": started, "created_at": F.first("at").over(so_far)})
    within = Window.partitionBy("session_id", "_island").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    counted = F.col("_base") + F.sum((kind == "clarified").cast("long")).over(within)

    def changed(pending: Column, e: Column) -> Column:
        added = F.when(F.array_contains(pending, e["batch"]), pending).otherwise(F.concat(pending, F.array(e["batch"])))
        return F.when(e["kind"] == "submitted", added).otherwise(F.filter(pending, lambda b: b != e["batch"]))

    moves = F.collect_list(F.when(kind.isin("submitted", "finished"), F.struct("kind", "batch"))).over(so_far)
    pending = F.aggregate(moves, F.array().cast("array<string>"), changed)
    of_turn = {c: F.col(f"_told.{c}") for c in TURN} | {
        "protocol": F.when(F.col("_told").isNull(), BY_MODEL).otherwise(F.col("_told.protocol")),
        # A turn without a count leaves none until the next question or answer.
        "clarifications": F.when((kind != "turn") & ~kind.isin("clarified", "answered") & (F.col("_n") == 0) & F.col("_none"), F.lit(None)).when((kind == "turn") & F.col("clarifications").isNull(), F.lit(None)).otherwise(F.col("_n")),
    }
    rows = rows.withColumns({"_n": counted, "_pending": pending})
    last_reset = F.last(F.when(kind == "turn", F.col("clarifications").isNull()).when(kind.isin("answered", "clarified"), F.lit(False)), ignorenulls=True).over(so_far)
    rows = rows.withColumn("_none", F.coalesce(last_reset, F.lit(False)))
    return rows.select("session_id", "seq", *[v.cast(TURN[c]).alias(c) for c, v in of_turn.items()], "created_at", F.col("at").alias("updated_at"), F.col("_pending").alias("pending"))


def latest(records: DataFrame) -> DataFrame:
    """One row: the record that changed last, to which a turn without a session of its own refers."""
    order = F.struct("updated_at", "session_id", "seq")
    return records.agg(F.max_by(F.struct(*records.columns), order).alias("r")).select("r.*").filter("session_id IS NOT NULL")
