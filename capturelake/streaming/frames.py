"""Counting frames as they arrive: the chain with its state kept by Spark."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from capturelake.operators.frames import RELEASE, Chain

_STATE = "running bigint, number bigint, next bigint, counted bigint, frames bigint, begun boolean"


def count_frames(frames: DataFrame, key: str = "path", release: int = RELEASE) -> DataFrame:
    """(key, counted, n_frames) after each batch, for a stream of candidates.

    A file's candidates are taken in the order of offsets within a batch; they
    must arrive in that order over batches, as one writer appends them.
    """

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        chain = Chain(release=release)
        if state.exists:
            chain.running, chain.number, chain.next, chain.counted, chain.frames, chain.begun = state.get
        rows: list[Any] = [r for b in batches for r in b.itertuples(index=False)]
        for r in sorted(rows, key=lambda r: r.off):
            chain.take(r.off, r.block_size, r.hlen, r.number, r.variable)
        state.update((chain.running, chain.number, chain.next, chain.counted, chain.frames, chain.begun))
        yield pd.DataFrame([(name[0], chain.counted, chain.frames)], columns=[key, "counted", "n_frames"])

    kind = frames.schema[key].dataType.simpleString()
    return frames.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, counted bigint, n_frames bigint", _STATE, "update", GroupStateTimeout.NoTimeout)
