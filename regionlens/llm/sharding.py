"""Operator 8: size-balanced shards of indivisible groups by Karmarkar-Karp differencing.

Documents with equal texts form a group that stays together. Groups are dealt over
cells of bounded size; each cell starts from one partial partition per group (its
size in one part, the others empty) and repeatedly combines the two partitions of
largest spread, adding the largest part of the one to the smallest of the other,
until a single partition of the cell is left. The cells' partitions, rows of one
number per shard, are combined in the same way, a bounded number of cells at a time.
Every task holds at most ``cell_groups`` groups whatever the input, and only part
numbers per cell travel back to the documents.

A text that a third of all documents share is one group: its rows are summed
map-side, and its documents meet their shard in a join with a written table, which
Spark splits. Slots are numbered in cells of a shard and shifted by the counts of
the cells before, so no task sees a whole shard.

Defined results: a null text is grouped with the empty text (16 bytes, CRC 0);
repeated rows get different slots; an empty table gives an empty table; equal sizes
are combined in the order of the groups' digests, so results don't depend on partitions.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from regionlens.llm.common import prepared, store

SHARDS = 40
OVERHEAD = 16
CELL_GROUPS = 20_000
CELL_PARTITIONS = 2_000
SLOT_ROWS = 20_000


def difference(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combine partial partitions (rows of ascending part sums) into one.

    Returns its ascending sums, and for each row and part the combined part it went to.
    """
    n, k = parts.shape
    heap = [(-int(row[-1] - row[0]), i) for i, row in enumerate(parts)]
    heapq.heapify(heap)
    sums: list[np.ndarray | None] = list(parts)
    # a node's children, and where their parts went in it
    joins: list[tuple[int, np.ndarray, int, np.ndarray]] = []
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        total = sums[a] + sums[b][::-1]
        order = np.argsort(total, kind="stable")
        place = np.empty(k, dtype=np.uint16)
        place[order] = np.arange(k, dtype=np.uint16)
        total = total[order]
        sums[a] = sums[b] = None
        sums.append(total)
        joins.append((a, place, b, place[::-1]))
        heapq.heappush(heap, (-int(total[-1] - total[0]), len(sums) - 1))
    where: list[np.ndarray | None] = [None] * len(sums)
    where[-1] = np.arange(k, dtype=np.uint16)
    for at in range(len(joins) - 1, -1, -1):
        a, pa_, b, pb = joins[at]
        up = where[n + at]
        where[a], where[b], where[n + at] = up[pa_], up[pb], None
    return sums[-1], np.stack(where[:n])


def cells_of(groups: DataFrame, shards: int, cell_groups: int) -> tuple[DataFrame, DataFrame]:
    """Difference every cell of ``groups`` (digest, size, cell): (digest, cell, part) and (cell, sums)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["digest"], ignore_index=True)
        parts = np.zeros((len(pdf), shards), dtype=np.int64)
        parts[:, -1] = pdf["size"]
        sums, where = difference(parts)
        return pd.DataFrame({"digest": pdf["digest"], "cell": pdf["cell"], "part": where[:, -1].astype("int32"), "sums": [sums.tolist()] + [None] * (len(pdf) - 1)})

    done = store(groups.groupBy("cell").applyInPandas(run, "digest binary, cell long, part int, sums array<long>"), "shard-cells")
    return done.select("digest", "cell", "part"), done.where("sums is not null").select("cell", "sums")


def combined(cells: DataFrame, shards: int, most: int) -> DataFrame:
    """(cell, place): for each part of each cell the shard it goes to."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["cell"], ignore_index=True)
        sums, where = difference(np.array(pdf["sums"].tolist(), dtype=np.int64).reshape(len(pdf), shards))
        return pd.DataFrame({"cell": pdf["cell"], "up": pdf["up"], "place": where.astype("int32").tolist(), "sums": [sums.tolist()] + [None] * (len(pdf) - 1)})

    n = cells.count()
    above = -(-n // most)
    tier = cells.withColumn("up", F.pmod("cell", F.lit(max(1, above))))
    done = store(tier.groupBy("up").applyInPandas(run, "cell long, up long, place array<int>, sums array<long>"), "shard-tier")
    if above <= 1:
        return done.select("cell", "place")
    higher = combined(done.where("sums is not null").select(F.col("up").alias("cell"), "sums"), shards, most)
    higher = higher.select(F.col("cell").alias("up"), F.col("place").alias("over"))
    return store(done.join(higher, "up").select("cell", F.transform("place", lambda p: F.get("over", p)).alias("place")), "shard-places")


def balanced_shards(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, cell_groups: int = CELL_GROUPS, cell_partitions: int = CELL_PARTITIONS, slot_rows: int = SLOT_ROWS
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of ``docs``."""
    prepared(docs.sparkSession)
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = store(
        docs.select(
            F.col(doc_id).cast("long").alias("doc_id"),
            (F.octet_length(t) + OVERHEAD).cast("long").alias("size"),
            F.crc32(t.cast("binary")).alias("text_crc32"),
            F.unhex(F.substring(F.sha2(t.cast("binary"), 256), 1, 32)).alias("digest"),
        ),
        "shard-rows",
    )
    sums = store(rows.groupBy("digest").agg(F.sum("size").alias("size")), "shard-groups")
    n_cells = max(1, -(-sums.count() // cell_groups))
    groups = sums.withColumn("cell", F.pmod(F.xxhash64("digest"), F.lit(n_cells)))
    group_part, cell_sums = cells_of(groups, shards, cell_groups)
    places = combined(cell_sums, shards, cell_partitions).withColumnRenamed("cell", "p_cell")
    assigned = group_part.join(places, F.col("cell") == F.col("p_cell")).select(F.col("digest").alias("g"), F.get("place", "part").alias("shard"))
    assigned = store(assigned, "shard-of-group")
    n_slots = max(4, -(-rows.count() // (shards * slot_rows)))
    put = rows.join(assigned, rows["digest"] == assigned["g"]).select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(n_slots)).alias("bin"))
    put = store(put, "shard-put")
    counts = put.groupBy("shard", "bin").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(F.col("shard").alias("s"), F.col("bin").alias("b"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("shift"))
    shifts = store(shifts, "shard-shifts")
    inside = Window.partitionBy("shard", "bin").orderBy("doc_id", "text_crc32", "size")
    numbered = put.withColumn("k", F.row_number().over(inside))
    return numbered.join(shifts, (F.col("shard") == F.col("s")) & (F.col("bin") == F.col("b"))).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("shift") + F.col("k") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
