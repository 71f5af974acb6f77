"""Mentions of a day against the day before, on a stream: keyed state that a timer closes.

The state of a name is the counts of its open days and of the last closed ones. When the watermark passes the end of a day, the day
is told with its count and the difference to the day before (NULL without a mention then); a count is kept until the day
after it is closed. Rows that are late, but inside the watermark, count; later ones are dropped, as in any watermarked stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DAY_MS = 86_400_000
OUT = "ticker long, day int, c long, delta long"


def _day(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    days, counts, told = state.get if state.exists else ([], [], [])
    count, told = dict(zip(days, counts, strict=True)), set(told)
    if not state.hasTimedOut:
        for batch in rows:
            for day, n in (batch["ts"].astype("datetime64[ms]").astype("int64") // DAY_MS).value_counts().items():
                count[int(day)] = count.get(int(day), 0) + int(n)
    mark = state.getCurrentWatermarkMs()
    over = sorted(d for d in count if d not in told and (d + 1) * DAY_MS <= mark)
    out = [(key[0], d, count[d], count[d] - count[d - 1] if d - 1 in count else None) for d in over]
    told |= set(over)
    for d in [d for d in told if (d + 2) * DAY_MS <= mark]:  # the day after it is closed too
        told.discard(d)
        del count[d]
    if count:
        state.update((list(count), list(count.values()), list(told)))
        state.setTimeoutTimestamp(max(mark + 1, min((d + (2 if d in told else 1)) * DAY_MS for d in count)))
    elif state.exists:
        state.remove()
    if out:
        yield pd.DataFrame(out, columns=["ticker", "day", "c", "delta"]).astype({"delta": "Int64"})


def mention_delta(events: DataFrame, late: str = "1 day") -> DataFrame:
    """A stream (ticker, ts) to ticker, day, c, delta, each day once it is over."""
    rows = events.withWatermark("ts", late).select("ticker", "ts")
    out = rows.groupBy("ticker").applyInPandasWithState(_day, OUT, "days array<long>, counts array<long>, told array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("ticker", F.date_from_unix_date("day").alias("day"), "c", "delta")
