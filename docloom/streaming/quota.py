"""The quota windows on a stream: each client's counters are the state, requests are decided as they arrive."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docloom.operators.folds import FixedWindow

OUTPUT = "client long, request long, verdict string"
STATE = "minute_start double, minute_count long, day_start double, day_count long"


def quota_stream(requests: DataFrame, per_minute: int, per_day: int) -> DataFrame:
    """client, request, verdict for a stream of client, request, at (seconds).

    Requests of one micro-batch are taken in the order of `at`, then request; over batches in order of arrival.
    """

    def decide(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        minute_start, minute_count, day_start, day_count = state.get if state.exists else (None, 0, None, 0)
        minute, day = FixedWindow(60.0, minute_start, minute_count), FixedWindow(86_400.0, day_start, day_count)
        out = []
        for r in pd.concat(list(frames)).sort_values(["at", "request"]).itertuples():
            m, d = minute.add(r.at), day.add(r.at)
            out.append((key[0], r.request, "minute" if m > per_minute else "day" if d > per_day else "served"))
        state.update((minute.start, minute.count, day.start, day.count))
        yield pd.DataFrame(out, columns=["client", "request", "verdict"])

    return requests.groupBy("client").applyInPandasWithState(decide, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
