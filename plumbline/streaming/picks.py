"""Debouncing picks: a pick of the same (user, cloud, index) within a short gap of the last accepted one is dropped."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

GAP_MS = 150


def _accepted(times: list[int], last: int | None, gap: int) -> tuple[list[bool], int | None]:
    keep = []
    for t in times:
        ok = last is None or t - last >= gap
        keep.append(ok)
        last = t if ok else last
    return keep, last


def debounce(picks: DataFrame, keys: list[str], gap_ms: int = GAP_MS, time: str = "ts") -> DataFrame:
    """Batch form. The clock restarts only on an accepted pick, so the rule runs in time order within a key: picks are dealt by key, sorted, and
    streamed past one accepted time a key. Nothing of a key is gathered; a key's picks are one task's work, in proportion to their number."""
    rest = [c for c in picks.columns if c not in (*keys, time)]
    tasks = int(picks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = picks.withColumn("_ms", F.unix_millis(F.col(time).cast("timestamp"))).repartition(tasks, *keys).sortWithinPartitions(*keys, time, *rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None
        for b in batches:
            own = list(zip(*(b.column(b.schema.get_field_index(k)).to_pylist() for k in keys), strict=True))
            keep = []
            for key, t in zip(own, b.column(b.num_columns - 1).to_pylist(), strict=True):
                if key != now:
                    now, last = key, None
                ok = last is None or (t is not None and t - last >= gap_ms)
                keep.append(ok)
                last = t if ok else last
            yield b.select(list(range(b.num_columns - 1))).filter(pa.array(keep, pa.bool_()))

    return dealt.mapInArrow(run, picks.schema)


def debounce_stream(picks: DataFrame, keys: list[str], gap_ms: int = GAP_MS, time: str = "ts", *, forget_ms: int | None = None) -> DataFrame:
    """Streaming form: the last accepted time of each key is kept as state, and dropped once the key was silent for ``forget_ms`` of the clock."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(time, kind="stable")
        at = (rows[time].astype("int64") // 10**6 if rows[time].dtype == "datetime64[ns]" else rows[time].astype("datetime64[ms]").astype("int64")).tolist()
        keep, last = _accepted(at, state.get[0] if state.exists else None, gap_ms)
        state.update((last,))
        if forget_ms:
            state.setTimeoutDuration(forget_ms)
        yield rows[keep]

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in picks.schema)
    return picks.groupBy(*keys).applyInPandasWithState(step, schema, "last long", "append", GroupStateTimeout.ProcessingTimeTimeout if forget_ms else GroupStateTimeout.NoTimeout)
