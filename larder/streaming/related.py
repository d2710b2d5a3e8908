"""Requests for more related posts as a stream: what a visit has been shown is kept between batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from larder.operators.posts import MOST


def streamed_claims(requests: DataFrame, idle_seconds: int = 3600) -> DataFrame:
    """``posts.claims`` of a stream of requests: the same places as over all requests at once, if they arrive in their order.

    The state of a visit and a post is one number, however many posts have been shown, and goes when
    the watermark is ``idle_seconds`` past the last request, after which a visit starts anew. Requests that arrive together are
    taken by time in batches of Arrow rows, so no visit is held whole.
    """
    kind = {f.name: f.dataType.simpleString() for f in requests.schema.fields}

    def claim(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        shown, latest = state.get if state.exists else (0, 0)
        for chunk in chunks:
            chunk = chunk.sort_values(["at", "request_id"])
            n = chunk["n"].fillna(1).clip(1, MOST).astype("int64")
            latest = max(latest, int(chunk["at"].max().timestamp() * 1000))
            yield pd.DataFrame({"visit": key[0], "post_id": key[1], "request_id": chunk["request_id"], "first": shown + n.cumsum() - n, "n": n})
            shown += int(n.sum())
        state.update((shown, latest))
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + idle_seconds * 1000)

    out = f"visit {kind['visit']}, post_id {kind['post_id']}, request_id {kind['request_id']}, first long, n long"
    asked = requests.where(F.col("at").isNotNull()).select("visit", "post_id", "request_id", "at", "n").withWatermark("at", f"{idle_seconds} seconds")
    return asked.groupBy("visit", "post_id").applyInPandasWithState(claim, out, "shown long, latest long", "append", GroupStateTimeout.EventTimeTimeout)
