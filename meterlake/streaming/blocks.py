"""Anchored five-hour blocks kept as state: each request opens a block or falls in the open one."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from meterlake.operators.survival import BLOCK_SECONDS

_OUT = "session_id string, start_epoch long, used_tokens long, used_requests long"


class _Blocks(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.block = handle.getValueState("block", "start long, prev long, tokens long, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        start, prev, tokens, n = self.block.get() if self.block.exists() else (None, None, 0, 0)
        for row in pd.concat(list(rows)).sort_values("timestamp_sec").itertuples():
            t = int(row.timestamp_sec)
            if start is None or t - start >= BLOCK_SECONDS or t - prev >= BLOCK_SECONDS:
                start, tokens, n = t, 0, 0
            prev, tokens, n = t, tokens + int(row.total_tokens), n + 1
        self.block.update((start, prev, tokens, n))
        yield pd.DataFrame({"session_id": [key[0]], "start_epoch": [start], "used_tokens": [tokens], "used_requests": [n]})

    def close(self) -> None:
        pass


def live_blocks(requests: DataFrame) -> DataFrame:
    """The open block of each session as requests arrive (in the order of time between batches)."""
    return requests.groupBy("session_id").transformWithStateInPandas(_Blocks(), _OUT, "Update", "None")
