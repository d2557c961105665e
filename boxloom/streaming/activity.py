"""Activity of points as a stream: state per point, errors for entries that don't change it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "id long, seq long, delta int, active boolean, valid boolean"


def _follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    active = state.get[0] if state.exists else False
    rows = pd.concat(list(frames)).sort_values("seq")
    out = []
    for seq, delta in zip(rows["seq"], rows["delta"]):
        valid = (delta == 1) != active
        active = active if not valid else delta == 1
        out.append((key[0], seq, delta, active, valid))
    state.update((bool(active),))
    yield pd.DataFrame(out, columns=["id", "seq", "delta", "active", "valid"])


def followed(log: DataFrame) -> DataFrame:
    """A stream of log(id, seq, delta) to what each entry leaves: whether the point is active, and whether the entry was valid (an insertion of what wasn't active, or a deletion of what was)."""
    return log.groupBy("id").applyInPandasWithState(_follow, OUT, "active boolean", "append", GroupStateTimeout.NoTimeout)
