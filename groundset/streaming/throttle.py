"""Sliding-window request limit per client, as a batch job and as a stateful stream.

A request is accepted while fewer than `limit` accepted ones lie in the window before it; rejected
ones do not count.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from groundset.operators.skew import with_prefix

# Requests per window and its length.
LIMIT = 60
WINDOW_SECONDS = 60


def _decide(recent: deque, now: int, limit: int, window: int) -> tuple[bool, int | None]:
    """Decision for one request at `now` (microseconds); `recent` holds accepted times."""
    while recent and recent[0] <= now - window:
        recent.popleft()
    if len(recent) >= limit:
        return False, max(1, int((window - (now - recent[0])) / 1_000_000))
    recent.append(now)
    return True, None


def _in_time_cells(rows: DataFrame, window: int, reach: int) -> DataFrame:
    """Rows in cells one window long, each also copied to the neighbour it can influence.

    Sliding windows then run per client and cell, never over a whole client.
    """
    cell = F.floor(F.col("us") / window)
    own = rows.withColumn("_cell", cell).withColumn("_own", F.lit(True))
    copy = rows.withColumn("_cell", cell + reach).withColumn("_own", F.lit(False))
    return own.unionByName(copy)


def throttle(requests: DataFrame, limit: int = LIMIT, window_seconds: int = WINDOW_SECONDS) -> DataFrame:
    """`(client, request_id, ts)` with `accepted` and `retry_after`.

    Where at most `limit` requests of any kind lie in a window, all of them are accepted: plain
    window functions settle these. The rest falls into stretches of overload, cut where no
    overloaded request lies within a window ahead; each stretch is replayed in time order as a
    stream of Arrow batches holding at most `limit` times in memory.
    """
    window = window_seconds * 1_000_000
    rows = requests.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    cells = Window.partitionBy("client", "_cell").orderBy("us")
    back = cells.rangeBetween(-(window - 1), 0)
    counted = _in_time_cells(rows, window, 1).withColumn("_seen", F.count(F.lit(1)).over(back))
    marked = counted.filter("_own").withColumn("_over", F.col("_seen") > limit).drop("_cell", "_own", "_seen")
    ahead = cells.rangeBetween(0, window - 1)
    hot = _in_time_cells(marked, window, -1).withColumn("_hot", F.bool_or("_over").over(ahead))
    hot = hot.filter("_own").drop("_cell", "_own", "_over")
    free = hot.filter(~F.col("_hot")).select(*requests.columns, F.lit(True).alias("accepted"), F.lit(None).cast("bigint").alias("retry_after"))
    busy = hot.filter("_hot").drop("_hot")
    # A stretch starts where no busy request lies in the window before.
    earlier = cells.rangeBetween(-(window - 1), -1)
    begun = _in_time_cells(busy, window, 1).withColumn("_near", F.count(F.lit(1)).over(earlier))
    begun = begun.filter("_own").drop("_cell", "_own")
    start = F.when(F.col("_near") == 0, F.col("us"))
    stretches = with_prefix(begun, ["client"], ["us", "request_id"], running_max={"stretch": start})
    columns = requests.columns
    schema = requests.select(*columns, F.lit(True).alias("accepted"), F.lit(None).cast("bigint").alias("retry_after")).schema

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, recent = None, deque()
        for batch in batches:
            accepted, waits = [], []
            for client, stretch, us in zip(batch["client"], batch["stretch"], batch["us"], strict=True):
                if (client, stretch) != place:
                    place, recent = (client, stretch), deque()
                ok, wait = _decide(recent, int(us), limit, window)
                accepted.append(ok)
                waits.append(wait)
            yield batch[columns].assign(accepted=accepted, retry_after=pd.array(waits, dtype="Int64"))

    ordered = stretches.repartition("client", "stretch").sortWithinPartitions("client", "stretch", "us", "request_id")
    return free.unionByName(ordered.mapInPandas(replay, schema))


def throttle_stream(
    requests: DataFrame, delay: str, limit: int = LIMIT, window_seconds: int = WINDOW_SECONDS
) -> DataFrame:
    """Streaming form; state is the accepted times of the last window.

    A client's state is dropped once the watermark is a window past its last request. Requests
    later than `delay` behind the newest one are outside the stream.
    """
    window = window_seconds * 1_000_000
    client_type = requests.schema["client"].dataType.simpleString()
    id_type = requests.schema["request_id"].dataType.simpleString()
    output = f"client {client_type}, request_id {id_type}, accepted boolean, retry_after bigint"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = deque(state.get[0] if state.exists else ())
        rows = pd.concat(list(batches)).sort_values(["us", "request_id"])
        decisions = [_decide(recent, int(us), limit, window) for us in rows["us"]]
        state.update((list(recent),))
        last_ms = max(int(rows["us"].iloc[-1]) // 1000, state.getCurrentWatermarkMs())
        state.setTimeoutTimestamp(last_ms + window_seconds * 1000)
        yield pd.DataFrame(
            {
                "client": [key[0]] * len(rows),
                "request_id": rows["request_id"].tolist(),
                "accepted": [d[0] for d in decisions],
                "retry_after": pd.array([d[1] for d in decisions], dtype="Int64"),
            }
        )

    at = F.col("ts").cast("timestamp")
    timed = requests.select("client", "request_id", at.alias("at"), F.unix_micros(at).alias("us"))
    return timed.withWatermark("at", delay).groupBy("client").applyInPandasWithState(
        step, output, "recent array<bigint>", "append", GroupStateTimeout.EventTimeTimeout
    )
