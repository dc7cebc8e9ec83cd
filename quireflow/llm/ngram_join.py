"""N-gram Jaccard join: a MinHash LSH forest of sorted prefix tries, then exact verification.

Every document is its set of five-word shingles. Documents with equal sets form
a class; classes are indexed in ``trees`` tries, each sorted by a signature of
``depth`` MinHash values. Classes under one prefix are candidates. Matching
starts at the full prefixes and shortens them until the recall, estimated from
the similarities of the candidates found so far, reaches the target.
Candidates are then grouped into candidate components, inside which all pairs
are verified exactly in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.llm import shingles as S
from quireflow.llm.common import binary_rows, discard, ragged, shuffle_partitions, store, whole_groups
from quireflow.llm.graph import block_pairs, components
from quireflow.llm.pairs import group_pairs, local_labels, set_intersections


@dataclass(frozen=True)
class Forest:
    """Parameters. ``slack`` standard deviations of a signature's estimate are allowed below the threshold.

    ``block`` members with their sets, ``signature_block`` with their signatures, meet as one side of a block pair.
    """

    threshold: float = 0.8
    trees: int = 16
    depth: int = 6
    target_recall: float = 0.9985
    slack: float = 4.0
    block: int = 128
    signature_block: int = 1024

    @property
    def hashes(self) -> int:
        return self.trees * self.depth

    @property
    def floor(self) -> float:
        t = self.threshold
        return t - self.slack * (t * (1 - t) / self.hashes) ** 0.5

    def capture(self, similarity: float, length: int) -> float:
        """Chance that two sets share a prefix of this length in some trie."""
        return 1 - (1 - similarity**length) ** self.trees


def signed(docs: DataFrame, forest: Forest) -> DataFrame:
    """(doc_id, fp1, fp2, n_sh, sig) of every document: set fingerprint, set size and signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for i, j, data, offsets in S.chunks(texts):
                _, _, h, first = S.words(data, offsets)
                sh, at = S.distinct_by_text(*S.shingle_hashes(h, first))
                one, two = S.fingerprints(sh, at)
                sig = S.signatures(sh, at, forest.hashes).astype(">u4").view(np.uint8)
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(np.diff(at)), binary_rows(sig, 4 * forest.hashes)], names=["doc_id", "fp1", "fp2", "n_sh", "sig"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp1 long, fp2 long, n_sh long, sig binary")


def _tries(classes: DataFrame, forest: Forest) -> DataFrame:
    """(tree, prefix, node): a row for every class and trie, the prefix big-endian so that it sorts as the values do."""
    width = 4 * forest.depth
    each = F.sequence(F.lit(0), F.lit(forest.trees - 1))
    return classes.select("node", "sig", F.explode(each).alias("tree")).select("node", "tree", F.substring("sig", F.col("tree") * width + 1, F.lit(width)).alias("prefix"))


def _candidates(tries: DataFrame, classes: DataFrame, forest: Forest, length: int) -> DataFrame:
    """Spanning links (a, b) of the candidates under prefixes of this length, and audit rows (a null, bin, n)."""
    at = tries.select("node", F.xxhash64("tree", F.substring("prefix", 1, 4 * length)).alias("bucket"))
    crowded = at.groupBy("bucket").agg(F.count("*").alias("bucket_n")).where("bucket_n > 1").select("bucket")
    dealt = block_pairs(at.join(crowded, "bucket"), "bucket", "node", forest.signature_block)
    rows = dealt.join(classes.select("node", "sig"), "node")
    order = ["bucket", "pair_i", "pair_j"]
    rows = rows.repartition(shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order, "node")
    trees, depth, hashes, floor = forest.trees, forest.depth, forest.hashes, forest.floor

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(batches, order):
            n = rows.num_rows
            node, own = rows.column("node").to_numpy(), rows.column("own").to_numpy()
            cross = rows.column("pair_i").to_numpy() != rows.column("pair_j").to_numpy()
            sig = ragged(rows.column("sig"))[0].reshape(n, hashes, 4).view(np.uint32).reshape(n, hashes)

            def agreement(p: np.ndarray, q: np.ndarray) -> np.ndarray:
                return np.concatenate([np.zeros(0), *(np.mean(sig[p[k : k + 8192]] == sig[q[k : k + 8192]], axis=1) for k in range(0, len(p), 8192))])

            def block(r: np.ndarray, c: np.ndarray) -> np.ndarray:
                return np.stack([np.mean(sig[i] == sig[c], axis=1) for i in r]) >= floor

            p, q = group_pairs(starts, n, own, cross, lambda p, q: agreement(p, q) >= floor, block)
            label = local_labels(n, p, q)
            linked = np.flatnonzero(label != np.arange(n))
            # for the audit a pair counts in the first trie whose prefix it shares
            estimate = agreement(p, q)
            if len(p):
                same = np.concatenate([(sig[p[k : k + 8192]] == sig[q[k : k + 8192]]).reshape(-1, trees, depth)[:, :, :length].all(axis=2).sum(axis=1) for k in range(0, len(p), 8192)])
                weight = 1.0 / np.maximum(same, 1)
            else:
                weight = estimate
            bins = np.floor(estimate * 50).astype(np.int64)
            share = np.bincount(bins, weights=weight, minlength=51)
            some = np.flatnonzero(share)
            a = pa.array(np.concatenate([node[linked], np.zeros(len(some), np.int64)]), mask=np.repeat([False, True], [len(linked), len(some)]))
            b = pa.array(np.concatenate([node[label[linked]], np.zeros(len(some), np.int64)]), mask=np.repeat([False, True], [len(linked), len(some)]))
            yield pa.RecordBatch.from_arrays([a, b, pa.array(np.concatenate([np.zeros(len(linked), np.int64), some]), pa.int64()), pa.array(np.concatenate([np.zeros(len(linked)), share[some]]))], names=["a", "b", "bin", "n"])

    return rows.select(*order, "own", "node", "sig").mapInArrow(run, "a long, b long, bin long, n double")


def estimated_recall(bins: list[tuple[int, float]], forest: Forest, length: int) -> float:
    """Share of all pairs at or over the threshold that prefixes of this length catch.

    Pairs found, by estimated similarity, over what they stand for (each found
    pair divided by its chance to be caught); with none found, the chance at
    the threshold itself.
    """
    found = stands = 0.0
    for b, n in bins:
        s = min(1.0, (b + 0.5) / 50)
        if s >= forest.threshold:
            found += n
            stands += n / forest.capture(s, length)
    return found / stands if stands else forest.capture(forest.threshold, length)


def ngram_jaccard_join(docs: DataFrame, forest: Forest = Forest()) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, component_id, kept.

    class_id is the smallest doc_id with the same shingle set, n_links the
    number of other documents of similarity >= threshold (copies counted, not
    listed), component_id the smallest doc_id reachable by links, kept whether
    the document is that one.

    Null or empty texts and texts without a word have no set: own class, no
    link, kept. A null doc_id gives null class and component, no links and
    kept. Rows of one doc_id count as one document each for n_links but share
    class and component, and stay or go together. An empty table gives an empty
    result; only doc_id and text are read, so other columns can't clash.
    """
    signs = store(signed(docs, forest))
    with_set = signs.where("n_sh > 0 and doc_id is not null")
    classes = store(with_set.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("node"), F.count("*").alias("size"), F.first("n_sh").alias("n_sh"), F.first("sig").alias("sig")))
    tries = _tries(classes, forest)
    length, links = forest.depth, None
    while True:
        discard(links)
        links = store(_candidates(tries, classes, forest, length))
        bins = [tuple(r) for r in links.where("a is null").groupBy("bin").agg(F.sum("n")).collect()]  # at most 51 rows
        # prefixes of one value catch a pair at the threshold with 1 - 0.2 ** 16, so that the target is always reached
        if estimated_recall(bins, forest, length) >= forest.target_recall:
            break
        if length == 1:
            raise ValueError(f"{forest.trees} trees cannot reach a recall of {forest.target_recall}")
        length -= 1
    groups = store(components(links.where("a is not null").select("a", "b")))
    verified = store(_verified(docs, groups, classes, forest))
    final = components(verified.select(F.col("node").alias("a"), F.col("to").alias("b")))
    counts = verified.groupBy("node").agg(F.sum("links").alias("links"))
    per_class = classes.select("fp1", "fp2", "node", "size").join(counts.join(final, "node"), "node", "left")
    mine = signs.where("n_sh > 0 and doc_id is not null").select("doc_id", "fp1", "fp2").join(per_class, ["fp1", "fp2"])
    mine = mine.select("doc_id", F.col("node").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).cast("long").alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    alone = signs.where("n_sh = 0 or doc_id is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("component_id"))
    return mine.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _verified(docs: DataFrame, groups: DataFrame, classes: DataFrame, forest: Forest) -> DataFrame:
    """(node, links, to) for every class and block pair in which it has links: their documents, and a smaller linked node."""
    wanted = groups.select(F.col("node").alias("doc_id"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in S.chunks(batch.column(1)):
                _, _, h, first = S.words(data, offsets)
                sh, at = S.distinct_by_text(*S.shingle_hashes(h, first))
                raw = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((at * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(sh))])
                one, two = S.fingerprints(sh, at)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), raw], names=["node", "fp1", "fp2", "sh"])

    shingled = texts.mapInArrow(sets, "node long, fp1 long, fp2 long, sh binary").dropDuplicates(["node", "fp1", "fp2"])
    shingled = store(shingled.join(classes.select("node", "fp1", "fp2", "size"), ["node", "fp1", "fp2"]).select("node", "size", "sh"))
    dealt = block_pairs(groups.select(F.col("component").alias("group"), "node"), "group", "node", forest.block)
    order = ["group", "pair_i", "pair_j"]
    rows = dealt.join(shingled, "node")
    rows = rows.repartition(shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order, "node")
    threshold = forest.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(batches, order, 512):
            n = rows.num_rows
            node, own, size = (rows.column(k).to_numpy() for k in ("node", "own", "size"))
            cross = rows.column("pair_i").to_numpy() != rows.column("pair_j").to_numpy()
            data, offsets = ragged(rows.column("sh"))
            sh, at = np.frombuffer(data.tobytes(), np.uint64), offsets // 8
            many = np.diff(at)
            by_pair, by_block = set_intersections(sh, at)

            def pairwise(p: np.ndarray, q: np.ndarray) -> np.ndarray:
                common = by_pair(p, q)
                return common >= threshold * (many[p] + many[q] - common) - 1e-9

            def block(r: np.ndarray, c: np.ndarray) -> np.ndarray:
                common = by_block(r, c)
                return common >= threshold * (many[r][:, None] + many[c] - common) - 1e-9

            p, q = group_pairs(starts, n, own, cross, pairwise, block)
            links = np.bincount(p, weights=size[q], minlength=n) + np.bincount(q, weights=size[p], minlength=n)
            label = local_labels(n, p, q)
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(links[some].astype(np.int64)), pa.array(node[label[some]])], names=["node", "links", "to"])

    return rows.select(*order, "own", "node", "size", "sh").mapInArrow(run, "node long, links long, to long")
