"""Embedding near-dedup by NN-descent.

Equal vectors are one class, and every class keeps a list of near neighbours.
Lists begin with what random hyperplane buckets show and are refined by joins
with the neighbours of neighbours until hardly any list changes. The number of
tables follows the number of vectors, so that a pair at the threshold misses
all buckets with the same small chance at every size. Lists that fill up with
links are saturated: for them the buckets are searched once more for the
nearest member of every *other* group, without a limit on groups, and lists are
enlarged to the whole group their links reach, whose cosines are computed in
double precision, block by block, so that links are counted and never listed.
The recall is then audited: some vectors with an id divisible by 50 are
compared with all rows in blocks; if links are missing, everything is repeated
with twice the tables, and an error ends it where that does not help.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quireflow.llm.common import binary_rows, discard, ragged, shuffle_partitions, store, whole_groups
from quireflow.llm.graph import block_pairs, components
from quireflow.llm.pairs import group_pairs, local_labels


@dataclass(frozen=True)
class Descent:
    """``floor``: cosine below which no pair is listed. ``neighbours``: length of a list while it is refined.

    ``miss``: chance that a pair at the threshold shares no bucket. ``audited``
    vectors at most, those with the smallest hashes of the ids divisible by
    ``every``, are compared with all rows; the recall is the mean of the shares
    of their links found, each vector that has links counting once, so that a
    large group hides nothing. ``doublings`` of the tables are tried.
    """

    threshold: float = 0.9
    floor: float = 0.6
    miss: float = 0.002
    neighbours: int = 8
    rounds: int = 4
    settled: float = 0.01
    target_recall: float = 0.99
    audited: int = 1024
    every: int = 50
    doublings: int = 3
    block: int = 1024
    vector_block: int = 512

    def tables(self, bits: int) -> int:
        """Tables of ``bits`` hyperplanes that leave a pair at the threshold without a shared bucket with chance ``miss``."""
        same = 1 - np.arccos(self.threshold) / np.pi
        return int(np.ceil(np.log(self.miss) / np.log1p(-(same**bits))))


#: Bits of a vector's sketch, by which bucket mates are sifted.
_SKETCH = 256


def unit_rows(lists: pa.Array) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """By dimension, row numbers and unit vectors in double precision; and which rows are valid.

    Invalid: null, empty, zero, or with a null or non-finite component.
    """
    flat = lists.flatten()
    sizes = np.diff(lists.offsets.to_numpy()) if not lists.null_count else np.array([0 if x is None else len(x) for x in lists.to_pylist()])
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    begin = np.cumsum(sizes) - sizes
    valid = np.zeros(len(lists), bool)
    out = []
    for d in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == d)
        m = values[begin[rows][:, None] + np.arange(d)]
        with np.errstate(invalid="ignore", over="ignore"):
            top = np.abs(m).max(axis=1)
            ok = np.isfinite(m).all(axis=1) & (top > 0)
        rows, m = rows[ok], m[ok] / top[ok][:, None]
        valid[rows] = True
        out.append((rows, m / np.linalg.norm(m, axis=1)[:, None]))
    return out, valid


def _units(vectors: DataFrame) -> DataFrame:
    """(vec_id, dim, v): the valid vectors, v being the unit vector's doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for rows, m in unit_rows(batch.column(1))[0]:
                if len(rows):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(np.full(len(rows), m.shape[1], np.int32)), binary_rows(m.view(np.uint8), 8 * m.shape[1])], names=["vec_id", "dim", "v"])

    mine = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    return mine.mapInArrow(run, "vec_id long, dim int, v binary").dropDuplicates(["vec_id", "v"])


def matrix_of(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(ragged(column)[0].tobytes(), np.float64).reshape(-1, dim)


def _planes(dim: int, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, n))


def _buckets(units: DataFrame, tables: int, bits: int) -> DataFrame:
    """(bucket, vec_id, sketch) for every class and table; at most 2 ** 12 tables of 40 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        weights = (1 << np.arange(bits, dtype=np.int64)).astype(np.float64)
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for d in np.unique(dims).tolist():
                if d not in planes:
                    planes[d] = (_planes(d, tables * bits, 1), _planes(d, _SKETCH, 2))
                rows = np.flatnonzero(dims == d)
                for i in range(0, len(rows), 1024):
                    part = pa.array(rows[i : i + 1024])
                    m = matrix_of(pa.chunked_array([batch.column(2).take(part)]), d)
                    code = ((m @ planes[d][0] > 0).reshape(len(m), tables, bits) @ weights).astype(np.int64)
                    bucket = code + (np.arange(tables, dtype=np.int64) << 40) + (np.int64(d % 2039) << 52)
                    sketch = np.packbits(m @ planes[d][1] > 0, axis=1)
                    ids = batch.column(0).take(part).to_numpy()
                    yield pa.RecordBatch.from_arrays([pa.array(bucket.ravel()), pa.array(np.repeat(ids, tables)), binary_rows(np.repeat(sketch, tables, axis=0), _SKETCH // 8)], names=["bucket", "vec_id", "sketch"])

    return units.select("vec_id", "dim", "v").mapInArrow(run, "bucket long, vec_id long, sketch binary")


def _sketch_limit(cosine: float) -> int:
    """Bits in which sketches differ: five standard deviations above the angle of the cosine."""
    angle = np.arccos(cosine) / np.pi
    return int(_SKETCH * angle + 5 * (_SKETCH * angle * (1 - angle)) ** 0.5)


def _mates(buckets: DataFrame, p: Descent, groups: DataFrame | None = None) -> DataFrame:
    """(a, b): for every vector and bucket the bucket mates with the nearest sketches, a list's length at most, and a spanning link.

    With ``groups`` (node, component), the nearest mate of every other group whose sketch is near enough for a link.
    """
    mates = buckets.select("bucket", F.col("vec_id").alias("node"), "sketch")
    if groups is None:
        mates = mates.withColumn("team", F.lit(0).cast("long"))
    else:
        mates = mates.join(groups, "node", "left").select("bucket", "node", "sketch", F.coalesce("component", "node").alias("team"))
    dealt = block_pairs(mates, "bucket", "node", p.block)
    order = ["bucket", "pair_i", "pair_j"]
    rows = dealt.repartition(shuffle_partitions(dealt.sparkSession), *order).sortWithinPartitions(*order, "node")
    teams = groups is not None
    most = _sketch_limit(p.threshold if teams else p.floor)
    keep = p.neighbours

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(batches, order):
            n = rows.num_rows
            node, own = rows.column("node").to_numpy(), rows.column("own").to_numpy()
            cross = rows.column("pair_i").to_numpy() != rows.column("pair_j").to_numpy()
            sketch = ragged(rows.column("sketch"))[0].reshape(n, -1).view(np.uint64)
            team = rows.column("team").to_numpy()

            def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
                return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)

            def block(r: np.ndarray, c: np.ndarray) -> np.ndarray:
                out = np.zeros((len(r), len(c)), bool)
                for k, i in enumerate(r):
                    d = apart(sketch[i], sketch[c]).astype(np.float64)
                    if teams:
                        some = np.flatnonzero((d <= most) & (team[c] != team[i]))
                        some = some[np.lexsort((d[some], team[c][some]))]
                        out[k, some[np.unique(team[c][some], return_index=True)[1]]] = True
                        continue
                    d[c == i] = np.inf
                    near = np.argpartition(d, keep)[:keep] if len(c) > keep else np.arange(len(c))
                    out[k, near[d[near] <= most]] = True
                if r is c:
                    out |= out.T
                return out

            a, b = group_pairs(starts, n, own, cross, lambda x, y: apart(sketch[x], sketch[y]) <= most, block)
            yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

    found = rows.select(*order, "own", "node", "team", "sketch").mapInArrow(run, "a long, b long").where("a <> b")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _scored(pairs: DataFrame, units: DataFrame, floor: float) -> DataFrame:
    """(a, b, cosine) of the pairs at or over the floor."""
    one = units.select(F.col("vec_id").alias("a"), F.col("dim").alias("dim_a"), F.col("v").alias("va"))
    two = units.select(F.col("vec_id").alias("b"), F.col("dim").alias("dim_b"), F.col("v").alias("vb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for d in np.unique(dims).tolist():
                part = pa.array(np.flatnonzero(dims == d))
                x, y = (matrix_of(pa.chunked_array([batch.column(k).take(part)]), d) for k in (3, 4))
                cosine = np.einsum("ij,ij->i", x, y)
                ok = cosine >= floor
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(part).filter(pa.array(ok)) for k in (0, 1)), pa.array(cosine[ok])], names=["a", "b", "cosine"])

    joined = pairs.join(one, "a").join(two, "b").where("dim_a = dim_b")
    return joined.select("a", "b", "dim_a", "va", "vb").mapInArrow(run, "a long, b long, cosine double")


def _lists(links: DataFrame, p: Descent) -> DataFrame:
    """(node, other): the nearest listed neighbours of every vector."""
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other"), "cosine").union(links.select("b", "a", "cosine"))
    best = Window.partitionBy("node").orderBy(F.desc("cosine"), "other")
    return both.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= p.neighbours).select("node", "other")


def _descended(units: DataFrame, p: Descent, tables: int, bits: int) -> DataFrame:
    """(a, b, cosine): the pairs listed when the lists have settled, and for saturated ones those of other groups."""
    links = store(_scored(_mates(_buckets(units, tables, bits), p), units, p.floor))
    for _ in range(p.rounds):
        lists = store(_lists(links, p))
        sides = lists.union(lists.select("other", "node")).distinct()
        hops = sides.select(F.col("other").alias("via"), F.col("node").alias("a")).join(lists.select(F.col("node").alias("via"), F.col("other").alias("b")), "via")
        fresh = hops.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(links.select("a", "b"), ["a", "b"], "left_anti")
        more = store(_scored(fresh, units, p.floor))
        # a pair is an improvement if it enters the list of one of its ends
        both = store(links.unionByName(more))
        changed = _lists(both, p).join(lists, ["node", "other"], "left_anti").count()
        total = lists.count()
        for old in (links, more, lists):
            discard(old)
        links = both
        if changed <= p.settled * total:
            break
    linked = links.where(F.col("cosine") >= p.threshold).select("a", "b")
    full = linked.select(F.col("a").alias("node")).union(linked.select("b")).groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") >= p.neighbours).select("node")
    full = store(full)
    if full.isEmpty():
        return links
    # a saturated list may hide links to other groups
    buckets = _buckets(units, tables, bits)
    crowded = buckets.join(full.withColumnRenamed("node", "vec_id"), "vec_id", "left_semi").select("bucket").distinct()
    across = _mates(buckets.join(crowded, "bucket", "left_semi"), p, store(components(linked)))
    return store(links.unionByName(_scored(across, units, p.threshold)))


def _counted(groups: DataFrame, units: DataFrame, p: Descent) -> DataFrame:
    """(node, links, to): exact numbers of linked vectors inside groups, and a smaller linked node, by block pair."""
    members = groups.select(F.col("component").alias("group"), "node")
    dealt = block_pairs(members, "group", "node", p.vector_block)
    order = ["group", "pair_i", "pair_j"]
    rows = dealt.join(units.select(F.col("vec_id").alias("node"), "dim", "size", "v"), "node")
    rows = rows.repartition(shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order, "node")
    threshold = p.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(batches, order, 2048):
            n = rows.num_rows
            node, own, dims, size = (rows.column(k).to_numpy() for k in ("node", "own", "dim", "size"))
            cross = rows.column("pair_i").to_numpy() != rows.column("pair_j").to_numpy()
            data, at = ragged(rows.column("v"))
            flat, at = np.frombuffer(data.tobytes(), np.float64), at // 8

            def vectors(i: np.ndarray) -> np.ndarray:
                return flat[at[i][:, None] + np.arange(dims[i[0]])]

            def similar(x: np.ndarray, y: np.ndarray) -> np.ndarray:
                return np.concatenate([np.einsum("ij,ij->i", vectors(x[k : k + 4096]), vectors(y[k : k + 4096])) for k in range(0, len(x), 4096)]) >= threshold

            # links only join vectors of one dimension, so a group has one
            a, b = group_pairs(starts, n, own, cross, similar, lambda r, c: vectors(r) @ vectors(c).T >= threshold)
            links = np.bincount(a, weights=size[b], minlength=n) + np.bincount(b, weights=size[a], minlength=n)
            label = local_labels(n, a, b)
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(links[some].astype(np.int64)), pa.array(node[label[some]])], names=["node", "links", "to"])

    return rows.select(*order, "own", "node", "dim", "size", "v").mapInArrow(run, "node long, links long, to long")


def _recall(units: DataFrame, counted: DataFrame, p: Descent) -> float | None:
    """Mean share of their links found, over the audited vectors that have links; None if none has.

    The audited vectors, a bounded number, are compared with all rows in blocks.
    """
    chosen = units.where(F.pmod("vec_id", F.lit(p.every)) == 0).orderBy(F.xxhash64("vec_id")).limit(p.audited).select("vec_id", "dim", "v").toArrow()
    if not chosen.num_rows:
        return None
    dims = chosen.column("dim").to_numpy()
    queries = {d: matrix_of(chosen.column("v").filter(pa.array(dims == d)), d) for d in np.unique(dims).tolist()}
    names = {d: chosen.column("vec_id").to_numpy()[dims == d] for d in queries}
    threshold = p.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine, size = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for d, q in queries.items():
                rows = np.flatnonzero(mine == d)
                total = np.zeros(len(q), np.int64)
                for i in range(0, len(rows), 4096):
                    some = rows[i : i + 4096]
                    near = matrix_of(pa.chunked_array([batch.column(2).take(pa.array(some))]), d) @ q.T >= threshold
                    total += size[some] @ near
                yield pa.RecordBatch.from_arrays([pa.array(names[d]), pa.array(total)], names=["node", "there"])

    there = units.select("dim", "size", "v").mapInArrow(run, "node long, there long").groupBy("node").agg(F.sum("there").alias("there"))
    own = units.select(F.col("vec_id").alias("node"), "size")
    both = there.join(own, "node").withColumn("there", F.col("there") - F.col("size")).where("there > 0").join(counted, "node", "left")
    return both.agg(F.avg(F.least(F.lit(1.0), F.coalesce("links", F.lit(0)) / F.col("there")))).first()[0]


def vector_near_dedup(vectors: DataFrame, p: Descent = Descent()) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row; links are cosines >= threshold.

    Vectors that are null, empty, zero, or hold null or non-finite components
    link with nothing, nor do vectors of different lengths. A null vec_id
    gives no links, a null component and kept. Rows that repeat vec_id and
    vector are one vector and come out each; different vectors of one vec_id
    share its links and component. An empty table gives an empty result. Other
    columns, labels among them, are not read.
    """
    every = store(_units(vectors).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(7), "v")}))
    classes = store(every.groupBy("h1", "h2").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("size")))
    units = store(every.join(classes, ["h1", "h2", "vec_id"]).select("vec_id", "dim", "size", "v"))
    bits = int(min(40, max(4, np.ceil(np.log2(max(units.count(), 2))))))
    tables = p.tables(bits)
    for _ in range(p.doublings + 1):
        links = _descended(units, p, tables, bits)
        groups = store(components(links.where(F.col("cosine") >= p.threshold).select("a", "b")))
        counted = store(_counted(groups, units, p))
        totals = store(counted.groupBy("node").agg(F.sum("links").alias("links")))
        recall = _recall(units, totals, p)
        if recall is None or recall >= p.target_recall:
            break
        tables *= 2
    else:
        raise RuntimeError(f"recall {recall:.4f} of the links audited after {p.doublings} doublings of the tables")
    final = components(counted.select(F.col("node").alias("a"), F.col("to").alias("b")))
    known = classes.select("h1", "h2", "size", F.col("vec_id").alias("node")).join(totals, "node", "left").join(final, "node", "left")
    known = known.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("links"), F.coalesce("component", "node").alias("component"))
    mine = every.select("vec_id", "h1", "h2").join(known, ["h1", "h2"]).groupBy("vec_id").agg(F.sum("links").alias("links"), F.min("component").alias("component"))
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(mine, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
