"""Sources outside the process: an executable that reads one framed request and writes one framed response.

A frame is a 4-byte big-endian length and that many bytes of JSON, 256 MiB at most. The request holds
protocol_version, role and the files; the response holds the role's rows, or an error.
"""

from __future__ import annotations

import json
import struct
import subprocess
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .files import SCHEMAS

PROTOCOL_VERSION = 1
MAX_FRAME = 256 << 20


def frame(message: dict) -> bytes:
    body = json.dumps(message).encode()
    if len(body) > MAX_FRAME:
        raise ValueError("frame too large")
    return struct.pack(">I", len(body)) + body


def unframe(raw: bytes) -> dict:
    if len(raw) < 4:
        raise ValueError("no frame")
    (size,) = struct.unpack(">I", raw[:4])
    if size > MAX_FRAME or len(raw) - 4 < size:
        raise ValueError("bad frame length")
    return json.loads(raw[4 : 4 + size])


def call(command: Sequence[str], request: dict, timeout: float = 600) -> dict:
    done = subprocess.run(list(command), input=frame(request), capture_output=True, timeout=timeout, check=True)
    answer = unframe(done.stdout)
    if answer.get("protocol_version") != PROTOCOL_VERSION:
        raise ValueError(f"protocol version {answer.get('protocol_version')}, not {PROTOCOL_VERSION}")
    if answer.get("error"):
        raise RuntimeError(answer["error"])
    return answer


def external(files: DataFrame, command: Sequence[str], role: str, config: dict | None = None) -> DataFrame:
    """Rows of an executable over (path, text); it is started once for each Arrow batch of files."""
    schema = to_arrow_schema(T._parse_datatype_string(SCHEMAS[role]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = [{"path": p, "text": t} for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            rows = call(command, {"protocol_version": PROTOCOL_VERSION, "role": role, "config": config or {}, "files": listed}).get(role, [])
            yield pa.RecordBatch.from_pylist([{f.name: r.get(f.name) for f in schema} for r in rows], schema=schema)

    return files.select("path", "text").mapInArrow(run, SCHEMAS[role])
