"""Conversation turns on a stream: what each reply means and whether it contradicts the last clear answer."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docloom.functions import text as tx

CLEAR = ("affirmative", "negative")


def conversation_stream(turns: DataFrame, affirmative: tuple[str, ...], negative: tuple[str, ...], unknown: tuple[str, ...], negations: tuple[str, ...]) -> DataFrame:
    """conv_id, turn, meaning, contradicts for a stream of conv_id, turn, text (replies of a user).

    Meanings are column expressions; the state is a conversation's last clear answer. Turns of one micro-batch are
    taken in order, over batches in order of arrival. Null texts are ambiguous.
    """
    meaning = tx.classify_reply(F.coalesce("text", F.lit("…")), affirmative, negative, unknown, negations)

    def judge(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for r in pd.concat(list(frames)).sort_values("turn").itertuples():
            clear = r.meaning in CLEAR
            out.append((key[0], r.turn, r.meaning, clear and last is not None and last != r.meaning))
            last = r.meaning if clear else last
        state.update((last,))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "meaning", "contradicts"])

    read = turns.select("conv_id", "turn", meaning.alias("meaning"))
    return read.groupBy("conv_id").applyInPandasWithState(judge, "conv_id long, turn long, meaning string, contradicts boolean", "last string", "append", GroupStateTimeout.NoTimeout)
