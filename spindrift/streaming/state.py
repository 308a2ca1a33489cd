"""The session fold as a stateful streaming operator, and event routing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spindrift.operators.online import SESSION_HOURS, STATE, Session

HELD = STATE.split(", ", 1)[1]


def restored(held: tuple) -> Session:
    s = Session()
    s.version, s.clicked, s.cart, s.recent, s.bounced, counts, s.last_kind, s.updated = (list(v) if not isinstance(v, str) and hasattr(v, "__iter__") else v for v in held)
    s.counts = {k: int(n) for k, _, n in (x.rpartition(":") for x in counts.split(",") if x)}
    return s


def session_stream(events: DataFrame) -> DataFrame:
    """The state of each user after every micro-batch that touches it, the same as the batch fold gives over the same events."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in STATE.split(", ")]
        if state.hasTimedOut:
            state.remove()
            return
        session = restored(state.get) if state.exists else Session()
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for ts, kind, item, category, duration in rows[["ts", "kind", "item", "category", "duration_ms"]].itertuples(index=False, name=None):
            session.apply(ts, kind, item, category, duration)
        row = session.row(key[0])
        state.update(row[1:])
        state.setTimeoutDuration(SESSION_HOURS * 3600 * 1000)
        yield pd.DataFrame([row], columns=names)

    return events.groupBy("user_id").applyInPandasWithState(run, STATE, HELD, "update", GroupStateTimeout.ProcessingTimeTimeout)


def routed(events: DataFrame) -> dict[str, DataFrame]:
    """The events of each counter: session takes all, cart the adding and taking, skip the quick closings."""
    quick = (F.col("kind").isin("item_close", "view")) & (F.coalesce("duration_ms", F.lit(0.0)) < 2000)
    return {"session": events, "cart": events.where(F.col("kind").isin("cart_add", "cart_remove", "click", "purchase")), "skip": events.where(quick)}
