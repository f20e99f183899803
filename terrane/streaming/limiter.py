"""A token bucket with continuous refill per identity, for batches and for streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def take(state: tuple[float, float] | None, at: float, capacity: float, refill: float) -> tuple[tuple[float, float], bool]:
    """One request: the bucket (tokens, time) after it, and whether it is admitted."""
    tokens, last = state or (capacity, at)
    tokens = min(capacity, tokens + max(0.0, at - last) * refill)
    return ((tokens - 1, at), True) if tokens >= 1 else ((tokens, at), False)


def admitted(events: DataFrame, key: str, at: str, order: str, capacity: float, refill: float) -> DataFrame:
    """Adds `admitted` to a batch; `at` is seconds. Rows stream through sorted partitions, so a task holds one bucket at
    a time and no identity's rows are gathered."""
    schema = events.schema.add("admitted", "boolean")
    dealt = events.repartition(key).sortWithinPartitions(key, at, order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = object(), None
        for batch in batches:
            out = []
            for k, t in zip(batch[key], batch[at], strict=True):
                if k != now:
                    now, state = k, None
                state, ok = take(state, float(t), capacity, refill)
                out.append(ok)
            yield batch.assign(admitted=out)

    return dealt.mapInPandas(run, schema)


def admitted_stream(events: DataFrame, key: str, at: str, capacity: float, refill: float) -> DataFrame:
    """(key, at, admitted) for a stream; the state of an identity is its bucket."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}

    def run(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bucket = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values(at)
        out = []
        for t in rows[at]:
            bucket, ok = take(bucket, float(t), capacity, refill)
            out.append(ok)
        state.update(bucket)
        yield pd.DataFrame({key: name[0], at: rows[at].to_numpy(), "admitted": out})

    return events.groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {at} {kinds[at]}, admitted boolean", "tokens double, last double", "append", GroupStateTimeout.NoTimeout)
