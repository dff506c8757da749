"""External programs: running one, finding one, and sending rows through one."""

from __future__ import annotations

import os
import shutil
import subprocess
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame


class Result(NamedTuple):
    code: int
    out: bytes
    err: bytes


def run_process(command: list[str], timeout: float | None = None, given: bytes | None = None) -> Result:
    """Exit code and both outputs, apart. A program that runs longer than ``timeout`` seconds is killed, and an OSError tells so."""
    try:
        done = subprocess.run(command, input=given, stdin=subprocess.DEVNULL if given is None else None, capture_output=True, timeout=timeout, check=False)
    except subprocess.TimeoutExpired as e:
        raise OSError(f"{os.path.basename(command[0])} ran longer than {timeout} s") from e
    return Result(done.returncode, done.stdout, done.stderr)


def locate(name: str, *folders: str) -> str | None:
    """The program ``name`` of the first folder that has it and may run it, else of the search path, else None."""
    for folder in folders:
        path = os.path.join(folder, name)
        if os.path.isfile(path) and os.access(path, os.X_OK):
            return path
    return shutil.which(name)


def pipe_values(rows: DataFrame, key: str, value: str, command: list[str], timeout: float | None = None) -> DataFrame:
    """key, code and out of the program run once on each row's ``value`` (binary; null gives null)."""
    of = rows.select(key, value)

    def run(batches):
        for b in batches:
            got = [None if v is None else run_process(command, timeout, v) for v in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array([g and g.code for g in got], pa.int32()), pa.array([g and g.out for g in got], pa.binary())], names=[key, "code", "out"])

    return of.mapInArrow(run, f"{key} {of.schema[key].dataType.simpleString()}, code int, out binary")
