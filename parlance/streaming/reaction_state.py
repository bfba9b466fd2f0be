"""Live reactions as keyed state: the last event of each (message, type), in the state store, with expiry.

A message's state is a map from reaction type to its last event by (at, at_id); a removal stays in it as a tombstone, so that a
late older add loses. Only events that change the map are handed on, with their place in the order, so the sink grows with what
changes. When a message has had no event for ``quiet`` its state expires: all of it was handed on before, and the fold over what
was handed on is the fold over all events. A straggler behind the expiry is handed on too, and loses in that fold if it is old.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parlance.operators import reactions

QUIET = 7 * 86_400_000
FIELDS = ["added", "sender", "ts", "at", "at_id"]
ARRIVED = "arrived_at"
# A frame is made for every message that changes, from columns of these types; changing types afterwards would cost as much again.
KINDS = {"tapback": "int32", "added": "bool", "ts": "Int64", "at": "int64", "at_id": "int64"}
EVENT = "added boolean, sender string, ts bigint, at bigint, at_id bigint"


def _place(tapback: int, sender: str | None, per_sender: bool) -> str:
    return json.dumps([tapback, sender if per_sender else None])


def last_events(names: list[str], per_sender: bool, quiet: int):
    """The function of one message's key: takes its events and its state, hands on what changes the state."""
    def take(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = json.loads(state.get[0]) if state.exists else {}
        changed, arrived = {}, state.getCurrentWatermarkMs()
        for part in parts:
            arrived = max(arrived, int(part[ARRIVED].to_numpy().max().astype("datetime64[ms]").astype("int64")))
            for tapback, added, sender, ts, at, at_id in zip(*(part[c].tolist() for c in ("tapback", *FIELDS))):
                sender = None if pd.isna(sender) else sender
                place = _place(int(tapback), sender, per_sender)
                told = [bool(added), sender, None if pd.isna(ts) else int(ts), int(at), int(at_id)]
                if place not in last or told[3:] > last[place][3:]:
                    last[place] = told
                    changed[place] = (*key, int(tapback), *told)
        state.update((json.dumps(last),))
        state.setTimeoutTimestamp(arrived + quiet)
        if changed:
            columns = zip([*names, "tapback", *FIELDS], zip(*changed.values()))
            yield pd.DataFrame({n: pd.array(values, KINDS[n]) if n in KINDS else list(values) for n, values in columns})

    return take


def changed_reactions(events: DataFrame, per_sender: bool = False, quiet: int = QUIET) -> DataFrame:
    """Streaming reaction events to the events that change the state: (store,) chat_id, target, tapback and the last event.

    ``quiet`` is in milliseconds. A message has at most six types (with ``per_sender`` as many more as people react to it), so
    its state is small.
    """
    names = [c for c in ("store", "chat_id", "target") if c in events.columns]
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    schema = ", ".join([*(f"{n} {kinds[n]}" for n in names), "tapback int", EVENT])
    # Quiet is measured on arrival: a watermark on it never holds back or drops an event, and moves with the batches.
    arrived = events.withColumn(ARRIVED, F.current_timestamp()).withWatermark(ARRIVED, "0 seconds")
    return arrived.groupBy(*names).applyInPandasWithState(
        last_events(names, per_sender, quiet), schema, "last string", "update", GroupStateTimeout.EventTimeTimeout)


def state_of(handed_on: DataFrame, per_sender: bool = False) -> DataFrame:
    """The reactions in place after all that was handed on, removals left out."""
    return reactions.last_event(handed_on, per_sender).filter("added").drop("added")
