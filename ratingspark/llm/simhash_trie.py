"""SimHash near-dedup: fingerprints in a binary trie that is joined with itself.

A text is lower-cased (A-Z) and cut into words at ASCII white space. Each shingle
of three words (repeats included; fewer words: the whole sequence) has a 64-bit
XXH64; a bit of the fingerprint is set if more than half of the hashes set it.
Fingerprints that differ in ``max_bits`` bits or fewer are linked, and documents
belong together if a chain of links joins them.

The trie join walks pairs of nodes of equal depth. A pair carries the bits in
which its two prefixes differ and is dropped when these exceed the budget, so
whole subtrees are never compared; small nodes are compared leaf by leaf.

Distribution: two fingerprints within ``max_bits`` bits agree in at least one of
``max_bits + 1`` equal blocks. Each distinct fingerprint goes into the trie of each of
its blocks, below the node that the block's value names; a task joins the tries
below its nodes. That is exact, sends every distinct fingerprint four times
whatever its links, and equal texts are merged before. A task returns a spanning
forest of the links it found, not the pairs; the forests are united by
``components``. The longest table of a task is one node's distinct fingerprints.

Null and empty texts have fingerprint zero and are linked like any other. A null
id never names a group unless all its ids are null; repeated rows are reported
repeatedly. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingspark.llm.common import documents, store, text_slices
from ratingspark.llm.components import components

SEED = 42
SHINGLE = 3
MAX_BITS = 3
#: Node pairs of at most so many leaf pairs are compared leaf by leaf.
LEAVES = 64
#: Node pairs that are walked at a time.
FRONT = 500_000
#: Leaf pairs that are compared at a time.
COMPARED = 2_000_000
#: Fingerprints whose tries are walked together.
CHUNK = 200_000


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-shingle] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1:].tolist())], ">u8")
    counts = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 60_000):
        counts += np.unpackbits(hashes[part:part + 60_000].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def _fingerprints(shingle: int, seed: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_slices(batches):
            found = np.array([fingerprint(t, shingle, seed) for t in piece.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                 seed: int = SEED) -> DataFrame:
    """``doc_id`` and its fingerprint ``fp`` as a signed long."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")) \
        .mapInArrow(_fingerprints(shingle, seed), "doc_id long, fp long")


class Trie:
    """Sorted 64-bit values as a binary trie: a node is a range of values with a common prefix."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.zeros: dict[int, np.ndarray] = {}

    def split(self, depth: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Where the child of bit 1 begins in each node."""
        if depth not in self.zeros:
            bit = (self.values >> np.uint64(63 - depth)) & np.uint64(1)
            self.zeros[depth] = np.concatenate([[0], np.cumsum(bit == 0)]).astype(np.int64)
        count = self.zeros[depth]
        return low + count[high] - count[low]

    def self_join(self, roots: np.ndarray, depth: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions (i < j) of values within ``budget`` bits below each node ``roots`` (begin, end)."""
        stack = [(depth, np.column_stack([roots, roots, np.full(len(roots), budget)]).astype(np.int64))]
        while stack:
            depth, front = stack.pop()
            if len(front) > FRONT:
                stack += [(depth, part) for part in np.array_split(front, -(-len(front) // FRONT))]
                continue
            leaf = (front[:, 1] - front[:, 0]) * (front[:, 3] - front[:, 2]) <= LEAVES
            if depth == 64:
                leaf[:] = True
            if leaf.any():
                due = front[leaf]
                ends = np.cumsum((due[:, 1] - due[:, 0]) * (due[:, 3] - due[:, 2]))
                for part in np.split(due, np.flatnonzero(np.diff(ends // COMPARED)) + 1):
                    yield self._leaves(part, budget)
            front = front[~leaf]
            if not len(front):
                continue
            al, ah, bl, bh, left = front.T
            am, bm = self.split(depth, al, ah), self.split(depth, bl, bh)
            same = al == bl
            children = [(al, am, bl, bm, left), (am, ah, bm, bh, left), (al, am, bm, bh, left - 1),
                        (am, ah, bl, bm, np.where(same, -1, left - 1))]
            grown = np.concatenate([np.column_stack(c) for c in children])
            grown = grown[(grown[:, 4] >= 0) & (grown[:, 0] < grown[:, 1]) & (grown[:, 2] < grown[:, 3])]
            lone = (grown[:, 0] == grown[:, 2]) & (grown[:, 1] - grown[:, 0] == 1)
            if len(grown := grown[~lone]):
                stack.append((depth + 1, grown))

    def _leaves(self, pairs: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
        al, ah, bl, bh, _ = pairs.T
        width = bh - bl
        n = (ah - al) * width
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        width = np.repeat(width, n)
        i, j = np.repeat(al, n) + k // width, np.repeat(bl, n) + k % width
        near = (i < j) & (np.bitwise_count(self.values[i] ^ self.values[j]) <= budget)
        return i[near], j[near]


def unite(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Add edges to a forest in which every position points at the smallest of its group."""
    while True:
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := parent[parent], parent):
            parent[:] = up


def _rotate(values: np.ndarray, bits: int) -> np.ndarray:
    return values if bits == 0 else (values << np.uint64(bits)) | (values >> np.uint64(64 - bits))


def _join_tries(width: int, budget: int):
    """Rows (bucket, fp) sorted by bucket: the links below each bucket's node as a forest."""
    def join(block: np.ndarray, fps: np.ndarray) -> pa.RecordBatch | None:
        edges: list[np.ndarray] = []
        for b in np.unique(block):
            values = np.sort(_rotate(fps[block == b], int(b) * width))
            node = values >> np.uint64(64 - width)
            begin = np.concatenate([[0], np.flatnonzero(node[1:] != node[:-1]) + 1])
            roots = np.column_stack([begin, np.append(begin[1:], len(values))])
            parent = np.arange(len(values))
            for i, j in Trie(values).self_join(roots[roots[:, 1] - roots[:, 0] > 1], width, budget):
                unite(parent, i, j)
            linked = np.flatnonzero(parent != np.arange(len(parent)))
            back = 64 - int(b) * width if b else 0
            edges.append(np.column_stack([_rotate(values[linked], back), _rotate(values[parent[linked]], back)]))
        out = np.concatenate(edges).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(out[:, 0].copy()), pa.array(out[:, 1].copy())], names=["u", "v"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for batch in batches:
            held.append((batch.column("bucket").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)))
            n += batch.num_rows
            if n >= CHUNK:
                bucket, fps = map(np.concatenate, zip(*held))
                whole = np.searchsorted(bucket, bucket[-1])  # the last bucket may go on
                if whole:
                    yield join(bucket[:whole] >> width, fps[:whole])
                held, n = [(bucket[whole:], fps[whole:])], len(bucket) - whole
        if n:
            bucket, fps = map(np.concatenate, zip(*held))
            yield join(bucket >> width, fps)

    return run


def link_fingerprints(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges ``u``, ``v`` that join all fingerprints ``fp`` (distinct) within ``max_bits`` bits."""
    blocks = max_bits + 1
    if 64 % blocks:
        raise ValueError("max_bits + 1 must divide 64")
    width = 64 // blocks
    part = [F.shiftrightunsigned("fp", 64 - width * (b + 1)).bitwiseAND((1 << width) - 1) + F.lit(b << width)
            for b in range(blocks)]
    buckets = distinct.select("fp", F.explode(F.array(*part)).alias("bucket"))
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return buckets.repartition(n, "bucket").sortWithinPartitions("bucket") \
        .mapInArrow(_join_tries(width, max_bits), "u long, v long")


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id``, ``fp``, ``component_id``: the smallest id of the document's group."""
    prints = store(fingerprints(docs, doc_id, text, shingle))
    distinct = store(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    edges = store(link_fingerprints(distinct.select("fp"), max_bits))
    roots = components(edges)
    named = distinct.join(roots, distinct.fp == roots.node, "left") \
        .select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = named.join(least, "root").select("fp", "component_id")
    return prints.join(labels, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and others) whose id names their group.

    Of rows with one id, one stays; of a group whose ids are all null, one stays.
    """
    groups = store(near_groups(docs, max_bits=max_bits))
    named = groups.filter("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(named, "doc_id", "left_semi")
    nameless = groups.filter("component_id is null").limit(1).collect()
    repeated = groups.filter("doc_id = component_id").groupBy("doc_id").count().filter("count > 1").limit(1).collect()
    if repeated:
        kept = kept.dropDuplicates(["doc_id"])
    if nameless:
        # Ids are missing for whole groups: one text of each such fingerprint group.
        texts = docs.filter("doc_id is null").withColumn("_id", F.xxhash64(F.coalesce("text", F.lit(""))))
        inner = near_groups(texts.select(F.col("_id").alias("doc_id"), "text"), max_bits=max_bits)
        lone = groups.filter("component_id is null").select("fp").distinct()
        chosen = inner.join(lone, "fp", "left_semi").filter("doc_id = component_id").select(F.col("doc_id").alias("_id")).distinct()
        kept = kept.unionByName(texts.join(chosen, "_id", "left_semi").dropDuplicates(["_id"]).select(*docs.columns))
    return kept


def op4_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(documents(spark, sf_dir).select("doc_id", "text"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
