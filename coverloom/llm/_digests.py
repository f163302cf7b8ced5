"""Digest columns that queries derive from token id lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._spark import arrow_map
from ._tokens import crc32s


def with_ids_crc32(df: DataFrame, ids: str = "ids") -> DataFrame:
    """df with ids_crc32 in place of its id lists."""
    schema = T.StructType([T.StructField("ids_crc32", T.LongType()) if f.name == ids else f for f in df.schema])
    at = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(at)
            offsets = np.asarray(lists.offsets).astype(np.int64)
            columns = list(batch.columns)
            columns[at] = pa.array(crc32s(np.asarray(lists.values), offsets))
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return arrow_map(df, run, schema)
