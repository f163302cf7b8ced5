"""Operator 8: token ids in Parquet list columns, in ascending document order.

Files hold (doc_id, n_tokens, part_start, part, ids). Id lists are dictionary encoded (vocabulary ids
repeat), the other columns delta encoded (format version 2, no dictionary for them); row groups and
pages are small enough that a reader fetches the pages of a few documents through the page index.
Each task writes one file with a range of doc_ids in ascending order and notes where a document's ids
start within the file, so that global starts need only the sums of files.

Defined cases: a null or empty text has the end id only; documents with equal ids stand next to each
other, ordered by text; a null id comes first; a very long text is one list; an empty table gives files
without rows; other columns never take part, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._spark import arrow_map, tables_root
from ._tokens import encode_batch, tokenizer_path

END_ID = 2
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
SCHEMA = "doc_id long, n_tokens long, part_start long, part int, ids array<int>"


def encode_ordered(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str, partitions: int) -> DataFrame:
    """Ids of every document; tasks hold ascending ranges of doc_ids."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for first, last, ids, offsets in encode_batch(batch.column(1), tokenizer, end_id):
                n = np.diff(offsets)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(n), pa.array(at + offsets[:-1]), pa.array(np.full(len(n), part, dtype=np.int32)), lists], names)
                at += int(offsets[-1])

    slim = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    return arrow_map(slim.repartitionByRange(partitions, "id").sortWithinPartitions("id", "text"), run, SCHEMA)


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None, row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES) -> None:
    partitions = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    encoded = encode_ordered(docs, tokenizer or tokenizer_path(), end_id, id_col, text_col, partitions)
    options = {"parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.writer.version": "PARQUET_2_0", "compression": "zstd", "parquet.enable.dictionary": "true"}
    options |= {f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "n_tokens", "part_start")}
    encoded.write.options(**{k: str(v) for k, v in options.items()}).parquet(path)


def read_token_files(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids; doc_ids selects through the page index."""
    files = spark.read.schema(SCHEMA).parquet(path)
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))  # a row a file
    bases = sums.select(F.col("part").alias("_part"), F.coalesce(before, F.lit(0)).cast("long").alias("_base"))
    wanted = files if doc_ids is None else files.where(F.col("doc_id").isin(doc_ids))
    return wanted.join(F.broadcast(bases), F.col("part") == F.col("_part")).select("doc_id", (F.col("_base") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def token_file_path(spark: SparkSession) -> str:
    return f"{tables_root(spark)}/tokens-{uuid.uuid4().hex}"
