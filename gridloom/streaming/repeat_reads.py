"""T1 as a stream: repeated small reads per session, with the last reads kept as state."""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridloom.operators.audit import READ_MEMORY, REPEAT_THRESHOLD

OUTPUT_SCHEMA = "session_id string, event_id long, key string, times_read long, warn boolean"
STATE_SCHEMA = "keys array<string>"


def _count_batch(session: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    recent = deque(state.get[0] if state.exists else [], maxlen=READ_MEMORY)
    counts = Counter(recent)
    # The reads of one session in one micro-batch, put in time order.
    reads = pd.concat(list(batches), ignore_index=True).sort_values(["created_at", "event_id"])
    times = []
    for key in reads["key"]:
        times.append(counts[key] + 1)
        if len(recent) == READ_MEMORY:
            counts[recent[0]] -= 1
        recent.append(key)
        counts[key] += 1
    state.update((list(recent),))
    yield pd.DataFrame({
        "session_id": session[0], "event_id": reads["event_id"], "key": reads["key"],
        "times_read": times, "warn": [t >= REPEAT_THRESHOLD for t in times],
    })


def stream_repeat_reads(reads: DataFrame) -> DataFrame:
    """Streaming reads (session_id, event_id, created_at, key) to counted reads, append mode.

    The rule is by order, not by time, so there is no watermark; state is at most the memory length
    per session.
    """
    return reads.groupBy("session_id").applyInPandasWithState(
        _count_batch, OUTPUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)
