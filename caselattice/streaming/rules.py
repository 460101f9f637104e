"""Streaming forms of the incremental operators.

Watermarks bound the state: a window is given up once the watermark has passed it, and late rows beyond that are dropped by
Spark. Spikes use sliding windows, whose starts lie on a grid, so they are a lower bound of the batch rule's windows that start
at each call.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import RULES, Rules
from ..sinks.files import append_new, upsert


def spikes(parties: DataFrame, rules: Rules = RULES, late: str = "1 day", slide: str = "1 hour") -> DataFrame:
    """Phones with many calls in a sliding day: ``phone, window, n_calls``."""
    counted = parties.withWatermark("ts", late).groupBy("phone", F.window("ts", f"{rules.spike_hours} hours", slide)).agg(F.count(F.lit(1)).alias("n_calls"))
    return counted.filter(F.col("n_calls") >= rules.spike_calls)


def fan_in(transfers: DataFrame, rules: Rules = RULES, late: str = "1 day", span: str = "7 days") -> DataFrame:
    """Accounts fed by several senders in a window; distinct senders are counted approximately, as streams require."""
    counted = transfers.withWatermark("ts", late).groupBy("dst", F.window("ts", span)).agg(F.approx_count_distinct("src", 0.01).alias("n_senders"), F.count(F.lit(1)).alias("n_transfers"))
    return counted.filter(F.col("n_senders") >= rules.fan_in_senders)


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions per key: ``key, session_window, n_events``."""
    return events.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n_events"))


def merged_turns(rows: DataFrame, key: str, longest: float, late: str = "1 hour") -> DataFrame:
    """Chunks of rows ``key, start, end`` of at most ``longest`` seconds, as a stateful operator; a chunk is emitted when the next begins or its key falls silent."""

    def step(names: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done = []
        if state.hasTimedOut:
            done.append((names[0], *state.get))
            state.remove()
        else:
            now = state.get if state.exists else None
            for batch in batches:
                for start, end in sorted(zip(batch["start"], batch["end"], strict=True)):
                    if now and end - now[0] <= longest:
                        now = (now[0], max(now[1], end), now[2] + 1)
                    else:
                        if now:
                            done.append((names[0], *now))
                        now = (float(start), float(end), 1)
            state.update(now)
            state.setTimeoutTimestamp(max(int((now[1] + longest) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(done, columns=[key, "first", "last", "n_rows"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.withWatermark("ts", late).groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, first double, last double, n_rows long", "first double, last double, n_rows long", "append", GroupStateTimeout.EventTimeTimeout
    )


def merge_into(stream: DataFrame, path: str, key: str, checkpoint: str, how: str = "replace"):
    """Start a query that upserts every micro-batch into a parquet table by key."""
    return stream.writeStream.foreachBatch(lambda df, _: upsert(df, path, key, how)).option("checkpointLocation", checkpoint).outputMode("append").start()


def append_into(stream: DataFrame, path: str, key: str, checkpoint: str):
    """Start a query that appends the rows of every micro-batch whose key is new; safe to repeat a batch."""
    return stream.writeStream.foreachBatch(lambda df, _: append_new(df, path, key)).option("checkpointLocation", checkpoint).start()
