"""Operator 5: consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `vnodes` points of a ring of `cells` cells; a key belongs to the shard of the next
point clockwise. No shard takes more than its capacity: keys that overflow continue clockwise to the
next shard with room, in the order of their hashes. With slack 0 the capacities add up to the number
of keys, so that the shards' row counts differ by one at most (law `rows`); with more slack fewer
keys leave their home shard. Keys that fit at home never move.

Only counts per cell (a number fixed by the ring, not by the data) reach the driver, which turns them
into runs (cell, rank from, rank to) -> (shard, first slot). Keys get their rank within a cell and
join the runs, so that no shard's rows ever meet in one task; nor do those of a large cell, such as one
that holds the rows of a frequent key.

Defined cases: a null key hashes as any value does; equal keys (repeated rows) stay neighbours on the
ring and are ordered by size and checksum; a null text has size 1 and the checksum 0 of no bytes; of a
very long text only size and checksum are shuffled; an empty table gives no rows; other columns are kept,
whatever their names, but for shard and slot, which are replaced.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._spark import fresh, small, table

CELLS = 1 << 14
VNODES = 128
CELL_ROWS = 1 << 20
MAX_BROADCAST_ROWS = 1_000_000


def ring_owners(n_shards: int, vnodes: int, cells: int) -> list[int]:
    """The shard of every cell: that of the next virtual node clockwise."""
    at: dict[int, int] = {}
    for shard in range(n_shards):
        for v in range(vnodes):
            cell = int.from_bytes(hashlib.md5(f"{shard}/{v}".encode()).digest()[:8], "big") % cells
            at[cell] = min(shard, at.get(cell, shard))
    owners, owner = [0] * cells, at[min(at)]
    for cell in range(cells - 1, -1, -1):
        owner = at.get(cell, owner)
        owners[cell] = owner
    if len(set(owners)) < n_shards:
        raise ValueError(f"{cells} cells leave a shard of {n_shards} without any; take more cells or fewer virtual nodes")
    return owners


def place(counts: dict[int, int], owners: list[int], n_shards: int, slack: float) -> list[tuple[int, int, int, int, int]]:
    """Runs (cell, rank from, rank to, shard, first slot) under capacities of (1 + slack) times the mean."""
    total = sum(counts.values())
    if slack > 0:
        room = [int((1 + slack) * total / n_shards) + 1] * n_shards
    else:
        room = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    filled, runs, rest = [0] * n_shards, [], []

    def put(cell: int, low: int, n: int, shard: int) -> int:
        took = min(n, room[shard] - filled[shard])
        if took > 0:
            runs.append((cell, low, low + took, shard, filled[shard]))
            filled[shard] += took
        return max(took, 0)

    for cell in sorted(counts):
        took = put(cell, 0, counts[cell], owners[cell])
        if took < counts[cell]:
            rest.append((cell, took))
    cells = len(owners)
    # from each cell towards the next one whose shard has room; full shards are left out for good
    ahead = list(range(cells))

    def open_cell(at: int) -> int:
        path = []
        while filled[owners[at]] >= room[owners[at]]:
            path.append(at)
            at = ahead[at] if ahead[at] != at else (at + 1) % cells
        for p in path:
            ahead[p] = at
        return at

    for cell, low in rest:
        at = cell
        while low < counts[cell]:
            at = open_cell(at)
            low += put(cell, low, counts[cell] - low, owners[at])
    return runs


def ring_shards(df: DataFrame, key: str, n_shards: int = 16, slack: float = 0.0, ties: tuple[str, ...] = (), vnodes: int = VNODES, cells: int = CELLS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """df with `shard` and `slot` (0, 1, ... within each shard), in place of columns of these names.

    Rows of a cell are ordered by the key's hash, the key and `ties`. A cell of more than `cell_rows` is first
    dealt into parts by key, ties and the task that wrote the row, so that no part grows with one key's rows.
    """
    spark = df.sparkSession
    kept = [c for c in df.columns if c.lower() not in {"shard", "slot"}]
    hashed, cell, dealt, part, rank, plan_col = fresh(df, "ring_hash", "ring_cell", "ring_deal", "ring_part", "ring_rank", "ring_run")
    keyed = df.withColumn(hashed, F.xxhash64(F.col(key)))
    keyed = keyed.withColumn(cell, F.shiftrightunsigned(hashed, 64 - (cells - 1).bit_length()).cast("int"))
    # written, so that the task of each row stays
    keyed = table(keyed.withColumn(dealt, F.xxhash64(F.col(key), *(F.col(t) for t in ties), F.spark_partition_id())), "ring-keys")
    counts = {r[cell]: r["n"] for r in keyed.groupBy(cell).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a cell at most
    runs = place(counts, ring_owners(n_shards, vnodes, cells), n_shards, slack)
    packed = json.dumps([{"c": c, "lo": lo, "hi": hi, "shard": s, "base": b} for c, lo, hi, s, b in runs])
    listed = F.from_json(F.lit(packed), "array<struct<c:int,lo:long,hi:long,shard:int,base:long>>")
    plan = spark.range(1).select(F.explode(listed).alias(plan_col))

    order = W.partitionBy(cell, part).orderBy(hashed, key, *ties)
    large = {c: -(-n // cell_rows) for c, n in counts.items() if n > cell_rows}
    parts = F.lit(1).cast("long")
    if large:
        sizes = F.from_json(F.lit(json.dumps({str(c): n for c, n in large.items()})), "map<string,long>")
        parts = F.coalesce(F.element_at(sizes, F.col(cell).cast("string")), parts)
    keyed = keyed.withColumn(part, F.pmod(F.col(dealt), parts))
    ranked = keyed.withColumn(rank, F.row_number().over(order).cast("long") - 1)
    if large:
        sizes = keyed.groupBy(F.col(cell).alias("own_cell"), F.col(part).alias("own_part")).agg(F.count(F.lit(1)).alias("n"))
        before = F.sum("n").over(W.partitionBy("own_cell").orderBy("own_part").rowsBetween(W.unboundedPreceding, -1))
        bases = table(sizes.select("own_cell", "own_part", F.coalesce(before, F.lit(0)).alias("before")), "ring-parts")
        joined = ranked.join(small(bases, bases.count(), MAX_BROADCAST_ROWS), (F.col(cell) == F.col("own_cell")) & (F.col(part) == F.col("own_part")))
        ranked = joined.select(*(ranked[c] for c in ranked.columns if c != rank), (ranked[rank] + F.col("before")).alias(rank))
    run = F.col(plan_col)
    met = (F.col(cell) == run["c"]) & (F.col(rank) >= run["lo"]) & (F.col(rank) < run["hi"])
    placed = ranked.join(F.broadcast(plan), met)
    return placed.select(*(F.col(f"`{c}`") for c in kept), run["shard"].alias("shard"), (run["base"] + F.col(rank) - run["lo"]).alias("slot"))


def shard_documents(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids, sizes and checksums of all documents with their shards; texts aren't shuffled."""
    raw = F.coalesce(docs[text_col].cast("binary"), F.lit(b""))
    size = (F.octet_length(raw) + 1).cast("long").alias("size")
    slim = docs.select(docs[id_col].cast("long").alias("doc_id"), size, F.crc32(raw).alias("text_crc32"))
    placed = ring_shards(slim, "doc_id", n_shards, 0.0, ("size", "text_crc32"))
    shard, grown = F.col("shard").cast("int").alias("shard"), F.lit(None).cast("int").alias("grown_shard")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard, "slot", grown)
