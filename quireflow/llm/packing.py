"""Conflict-constrained best-fit packing.

Documents are dealt by hash to shards of about ``shard_rows`` rows, which pack
independently, so that no task grows with the corpus or with one source. In a
shard, pieces go largest first into the tightest bin that has room and does not
yet hold their source or their duplicate cluster: bins stand in order of what
is left in them and carry one bitmap of sources and one of clusters; the
successor search starts at the piece's size and goes on until it finds a
compatible bin, or opens a new one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.llm.common import shuffle_partitions, store, whole_groups


@dataclass(frozen=True)
class Bins:
    capacity: int = 2048
    shard_rows: int = 4096


#: Copies of one item numbered in one go.
_COPIES = 4096


class Shard:
    """The open bins of a shard: per remaining size, bitmap of sources -> bins with it."""

    def __init__(self, capacity: int):
        self.capacity, self.count = capacity, 0
        self.levels: dict[int, dict[int, list[tuple[int, int]]]] = {}
        self.open = 0  # bit r: some bin has r left

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """The bin for a piece with these bits (0: none) and where in it the piece starts."""
        left = self.open >> size
        room = size
        while left:
            skip = (left & -left).bit_length() - 1
            room += skip
            level = self.levels[room]
            for mask, bins in level.items():
                if mask & source:
                    continue
                for k in range(len(bins) - 1, -1, -1):
                    number, clusters = bins[k]
                    if not clusters & cluster:
                        bins.pop(k)
                        if not bins:
                            del level[mask]
                            if not level:
                                del self.levels[room]
                                self.open &= ~(1 << room)
                        self._put(number, room - size, mask | source, clusters | cluster)
                        return number, self.capacity - room
            left >>= skip + 1
            room += 1
        number = self.count
        self.count += 1
        self._put(number, self.capacity - size, source, cluster)
        return number, 0

    def _put(self, number: int, room: int, sources: int, clusters: int) -> None:
        if room:
            self.levels.setdefault(room, {}).setdefault(sources, []).append((number, clusters))
            self.open |= 1 << room


def pack_shard(ids: np.ndarray, sizes: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(row, piece, bin, start in the document, size, start in the bin) of all pieces of a shard's rows.

    A document over the capacity fills whole bins of its own first. -1 in
    ``sources`` or ``clusters`` means none.
    """
    shard, out = Shard(capacity), []
    bits: list[dict[int, int]] = [{}, {}]

    def bit(kind: int, value: int) -> int:
        return 0 if value < 0 else 1 << bits[kind].setdefault(value, len(bits[kind]))

    for row in np.lexsort((ids, -(sizes % capacity))):
        whole, rest = divmod(int(sizes[row]), capacity)
        for piece in range(whole):
            out.append((row, piece, shard.count, piece * capacity, capacity, 0))
            shard.count += 1
        if rest:
            number, at = shard.place(rest, bit(0, int(sources[row])), bit(1, int(clusters[row])))
            out.append((row, whole, number, whole * capacity, rest, at))
    return out


def best_fit_packing(items: DataFrame, bins: Bins = Bins()) -> DataFrame:
    """(doc_id, piece, bin_id, doc_start, n_words, bin_start) from items (doc_id, n_words, source, cluster).

    source and cluster may be of any type; null ones conflict with nothing.
    Items of size null or 0 give one row with a null bin. Repeated rows are
    packed each, in different bins unless their cluster is null. A null doc_id
    is packed like any other. Ties go by doc_id. An empty table gives an empty
    result.
    """
    spark = items.sparkSession
    shards = max(1, -(-items.count() // bins.shard_rows))
    code = [F.when(F.col(c).isNull(), F.lit(-1).cast("long")).otherwise(F.xxhash64(c).bitwiseAND(F.lit((1 << 62) - 1))).alias(c) for c in ("source", "cluster")]
    dealt = items.select(F.col("doc_id").cast("long"), F.coalesce(F.col("n_words").cast("long"), F.lit(0).cast("long")).alias("n_words"), *code)
    # rows that repeat an item are numbered, a few thousand at a time, and dealt like any other
    many = dealt.groupBy("doc_id", "n_words", "source", "cluster").agg(F.count("*").alias("copies"))
    parts = many.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / _COPIES))))
    first = F.col("part") * _COPIES
    dealt = parts.withColumn("copy", F.explode(F.sequence(first, F.least(first + _COPIES, F.col("copies")) - 1))).drop("part", "copies")
    dealt = store(dealt.withColumn("shard", F.pmod(F.xxhash64("doc_id", "n_words", "cluster", "copy"), F.lit(shards))))
    parts = min(shards, shuffle_partitions(spark))
    rows = dealt.where("n_words > 0").repartition(parts, "shard").sortWithinPartitions("shard", "doc_id")
    capacity = bins.capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(batches, ["shard"], 1):
            shard = rows.column("shard").to_numpy()
            ids = rows.column("doc_id").to_numpy(zero_copy_only=False)
            order = np.where(np.isnan(ids), -np.inf, ids) if ids.dtype.kind == "f" else ids
            sizes, sources, clusters = (rows.column(k).to_numpy() for k in ("n_words", "source", "cluster"))
            for a, b in zip(starts, np.append(starts[1:], rows.num_rows)):
                placed = np.array(pack_shard(order[a:b], sizes[a:b], sources[a:b], clusters[a:b], capacity), dtype=np.int64).reshape(-1, 6)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").combine_chunks().take(pa.array(placed[:, 0] + a)), pa.array(placed[:, 1]), pa.array((int(shard[a]) << 32) + placed[:, 2]), *(pa.array(placed[:, k]) for k in (3, 4, 5))], names=["doc_id", "piece", "bin_id", "doc_start", "n_words", "bin_start"])

    packed = rows.select("shard", "doc_id", "n_words", "source", "cluster").mapInArrow(run, "doc_id long, piece long, bin_id long, doc_start long, n_words long, bin_start long")
    none = F.lit(None).cast("long")
    empty = dealt.where("n_words <= 0").select("doc_id", F.lit(0).cast("long").alias("piece"), none.alias("bin_id"), F.lit(0).cast("long").alias("doc_start"), F.lit(0).cast("long").alias("n_words"), none.alias("bin_start"))
    return packed.unionByName(empty)


def packing_items(docs: DataFrame) -> DataFrame:
    """Items of a documents table: words as size, and equal whole texts as duplicate cluster."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return docs.select("doc_id", words.alias("n_words"), "source", F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("cluster"))
