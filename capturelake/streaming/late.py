"""Counting frames whose headers arrive out of order.

Candidates wait in a list of their file until the watermark says that all
written before them have come; then they are taken in the order of offsets.
So the result is that of the batch chain, whatever the order within the delay.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from capturelake.operators.frames import RELEASE, Chain

_STATE = "running bigint, number bigint, next bigint, counted bigint, frames bigint, begun boolean"
_WAITING = "ms bigint, off bigint, block_size bigint, hlen bigint, number bigint, variable boolean"


class LateFrames(StatefulProcessor):
    """The chain of one file and the candidates that wait for others before them."""

    def __init__(self, key: str, at: str, release: int) -> None:
        self.key, self.at, self.release = key, at, release

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)
        self.chain = handle.getValueState("chain", _STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = None
        for batch in rows:
            batch = batch[batch["off"].notna()]
            if not len(batch):
                continue
            # a time is up when the watermark has passed it, so fractions count up
            ms = [-(-t.value // 1_000_000) for t in batch[self.at]]
            columns = [batch[c].tolist() for c in ("off", "block_size", "hlen", "number", "variable")]
            self.waiting.appendList([(m, int(o), int(b), int(h), int(n), bool(v)) for m, o, b, h, n, v in zip(ms, *columns, strict=True)])
            last = max(ms) if last is None else max(last, *ms)
        if last is not None:
            self.handle.registerTimer(last)
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        until = timerValues.getCurrentWatermarkInMs()
        here, rest = [], []
        for x in self.waiting.get():
            (here if x[0] <= until else rest).append(tuple(x))
        if not here:  # an earlier timer has taken them
            return
        chain = Chain(release=self.release)
        if self.chain.exists():
            chain.running, chain.number, chain.next, chain.counted, chain.frames, chain.begun = self.chain.get()
        for _, *x in sorted(here, key=lambda x: x[1:]):
            chain.take(*x)
        self.chain.update((chain.running, chain.number, chain.next, chain.counted, chain.frames, chain.begun))
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        yield pd.DataFrame([(key[0], chain.counted, chain.frames)], columns=[self.key, "counted", "n_frames"])


def count_late_frames(frames: DataFrame, key: str = "path", at: str = "at", delay: str = "10 minutes", release: int = RELEASE) -> DataFrame:
    """(key, counted, n_frames) whenever a file's chain moves on, for a stream of
    candidates that come up to ``delay`` late.

    ``at`` is when a candidate was written: later for greater offsets of a
    file.  Candidates over ``delay`` late are dropped, as the watermark has it;
    those with equal times must not be on both sides of it.  State is what
    waits: the candidates of ``delay``.  The session's state store must be
    RocksDB's.
    """
    kind = frames.schema[key].dataType.simpleString()
    keyed = frames.withWatermark(at, delay).groupBy(key)
    return keyed.transformWithStateInPandas(LateFrames(key, at, release), f"{key} {kind}, counted bigint, n_frames bigint", "Update", "EventTime")
