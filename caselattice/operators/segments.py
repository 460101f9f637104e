"""Ordered folds over time: merging turns, cutting segments by label overlap or by vectors, throttling.

A fold is sequential within a run of its key: a gap longer than a segment may last always starts a new one, so keys are cut at such
gaps first and the runs of a busy key are spread. Rows are hashed by (key, run), sorted inside the partitions and streamed through
the fold in Arrow batches: a task holds one open segment, never a run's rows, and sorting spills. Runs share tasks, so many small
ones cost no more than their rows.

Defined results: rows with a null key or start are left out; ties are ordered by the given id; a null label list is empty
and two empty lists do not overlap; a segment's length is measured from its first row; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rolling import runs


def fold(df: DataFrame, key: str, start: str, tie: str, columns: list[str], schema: str, step: Callable, gap: float) -> DataFrame:
    """Stream the rows of each key in order through ``step(state, row) -> (state, finished row or None)``.

    ``state`` is None at the start of a key and a list whose head is the open output row afterwards; it is emitted when
    the run ends. Rows more than ``gap`` apart never share a segment.
    """
    names = list(dict.fromkeys([key, start, tie, *columns]))
    out_names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for batch in batches:
            done = []
            for row in zip(*(batch[c] for c in (*names, "_run")), strict=True):
                if state is not None and (row[0], row[-1]) != now:
                    done.append(state[0])
                    state = None
                now = (row[0], row[-1])
                state, finished = step(state, dict(zip(names, row[:-1], strict=True)))
                if finished is not None:
                    done.append(finished)
            yield pd.DataFrame(done, columns=out_names)
        if state is not None:
            yield pd.DataFrame([state[0]], columns=out_names)

    timed = df.select(*names).withColumn("_at", (F.col(start) * 1_000_000).cast("long"))
    kept = runs(timed, key, "_at", tie, int(gap * 1_000_000), "_run").drop("_at")
    return kept.select(*names, "_run").repartition(key, "_run").sortWithinPartitions(key, "_run", start, tie).mapInPandas(run, schema)


def merge_turns(df: DataFrame, key: str, start: str, end: str, tie: str, longest: float) -> DataFrame:
    """Chunks of consecutive rows: a row extends the chunk while its end lies within ``longest`` of the chunk's start."""

    def step(state, r):
        if state and r[end] - state[0][1] <= longest:
            k, first, last, n = state[0]
            return [(k, first, max(last, r[end]), n + 1)], None
        return [(r[key], r[start], r[end], 1)], state[0] if state else None

    return fold(df, key, start, tie, [end], f"{key} {df.schema[key].dataType.simpleString()}, first double, last double, n_rows long", step, longest)


def label_segments(df: DataFrame, key: str, at: str, labels: str, tie: str, least: float, longest: float) -> DataFrame:
    """Segments of frames whose labels overlap those gathered so far (Jaccard) and that stay within ``longest``."""

    def step(state, r):
        now = set(r[labels]) if r[labels] is not None else set()
        if state:
            (k, first, _, n, _), seen = state
            both = seen | now
            if both and len(seen & now) / len(both) >= least and r[at] - first <= longest:
                return [(k, first, r[at], n + 1, ",".join(sorted(both))), both], None
        return [(r[key], r[at], r[at], 1, ",".join(sorted(now))), now], state[0] if state else None

    return fold(df, key, at, tie, [labels], f"{key} {df.schema[key].dataType.simpleString()}, first double, last double, n_rows long, labels string", step, longest)


def vector_segments(df: DataFrame, key: str, at: str, vector: str, tie: str, least: float, longest: float) -> DataFrame:
    """Segments of frames whose vector stays near the segment's mean (cosine) and within ``longest``."""

    def step(state, r):
        v = np.asarray(r[vector], np.float64)
        if state:
            (k, first, _, n), total = state
            size = np.linalg.norm(total) * np.linalg.norm(v)
            if r[at] - first <= longest and size and float(total @ v) / size >= least:
                return [(k, first, r[at], n + 1), total + v], None
        return [(r[key], r[at], r[at], 1), v], state[0] if state else None

    return fold(df, key, at, tie, [vector], f"{key} {df.schema[key].dataType.simpleString()}, first double, last double, n_rows long", step, longest)


def throttled(df: DataFrame, key: str, at: str, tie: str, every: float) -> DataFrame:
    """The rows a throttle lets pass: the first, then each that comes ``every`` or more after the last that passed."""

    def step(state, r):
        if state and r[at] - state[0][2] < every:
            return state, None
        return [(r[key], r[tie], r[at])], state[0] if state else None

    kinds = {c: df.schema[c].dataType.simpleString() for c in (key, tie)}
    return fold(df, key, at, tie, [], f"{key} {kinds[key]}, {tie} {kinds[tie]}, at double", step, every)
