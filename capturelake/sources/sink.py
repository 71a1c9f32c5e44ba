"""Writing cuts: samples with Spark, or files through an external program."""

from __future__ import annotations

import shutil
import subprocess
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame

from capturelake.operators.trim import trim_blocks

RESULT = "in_path string, out_path string, ok boolean, exit_code int, stderr string"


def write_cut(blocks: DataFrame, plans: DataFrame, path: str, key: str = "capture_id", size: int | None = 65536) -> None:
    """Write the planned cuts of decoded blocks of ``size`` samples, in order, as
    Parquet; for audio files see ``writer``."""
    trim_blocks(blocks, plans, key, size).sortWithinPartitions(key, "first_sample").write.parquet(path)


def tool_available(tool: str = "sox") -> bool:
    """Whether the program is there and tells its version."""
    return shutil.which(tool) is not None and subprocess.run([tool, "--version"], capture_output=True, check=False).returncode == 0


def run_tool(in_path: str, out_path: str, start: int, length: int, tool: str = "sox") -> tuple[bool, int, str]:
    """Cut one file; (ok, exit code, what it said).  Exit code -1: it did not start."""
    try:
        done = subprocess.run([tool, in_path, out_path, "trim", f"{start}s", f"{length}s"], capture_output=True, check=False)
    except OSError as e:
        return False, -1, f"failed to spawn {tool}: {e}"
    return done.returncode == 0, done.returncode, done.stderr.decode("utf-8", "replace")


def cut_files(plans: DataFrame, tool: str = "sox") -> DataFrame:
    """A row of RESULT for each of ``plans`` (in_path, out_path, start_samples,
    length_samples).  A cut that fails is a row, not a failed job.  Running it
    again cuts again: write the result once."""

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pandas as pd

        for batch in batches:
            rows = [(a, b, *run_tool(a, b, int(s), int(n), tool)) for a, b, s, n in batch.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["in_path", "out_path", "ok", "exit_code", "stderr"])

    return plans.select("in_path", "out_path", "start_samples", "length_samples").mapInPandas(run, RESULT)
