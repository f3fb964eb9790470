"""Texts of Arrow batches as flat byte arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows of texts that one Arrow batch may hold; a worker's memory follows it, and texts can be long.
ROWS = 1024


def bounded(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches hold at most ``ROWS`` rows; a lower setting stays."""
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= ROWS:
        conf.set(key, str(ROWS))
    return df


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column (null: empty) and the n + 1 offsets into them, without copying."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if not n or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def byte_texts(column: pa.Array) -> Iterator[bytes]:
    """Each text's UTF-8 bytes (null: empty)."""
    raw, ends = flat_bytes(column)
    view = memoryview(raw)
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        yield bytes(view[a:b])
