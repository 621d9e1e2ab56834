"""Near-dedup of the pipeline: tries of SimHash fingerprints with a wide budget, then exact Jaccard similarity.

Words are cut as in ``simhash_trie``; a text's set holds the XXH64 of its shingles of five
words (fewer words: the whole sequence). Two texts are near copies if the Jaccard
similarity of their sets is 0.8 or more, and rows belong together if a chain joins them.
Texts of equal sets are merged first.

Blocks: a pair of similarity s shares one of the first n - ceil(s n) + 1 hashes of both
sets (n hashes in a set), in any order that is the same for all sets, so each distinct set is sent to a block for each of these
and no such pair is lost. Rare hashes come first: a table of 2^22 counters, filled from all texts, tells how often a hash occurs at most. A shingle
that many texts share would else, if its hash is small, be a block that grows with the corpus and chains unlike texts into one candidate component.
The fingerprints of a block are a binary trie below the block's hash, as those of ``simhash_trie`` are below the
value of 16 bits; a task joins the tries below its blocks with themselves. Sets are candidates if their SimHash
fingerprints differ in ``BUDGET`` bits or fewer and their sizes allow the similarity; at 0.8 they differ in about 10 of 64
(deviation 3). Sets under ``SMALL`` shingles have unsteady fingerprints and skip that test. A block
whose sets are all candidates with its first one is a star without a walk.

A block's task returns a forest of its candidate links. Texts of each candidate component then
meet in one task, which compares whole sets and returns a forest of the links that hold. Pairs
that a chain joins already are not compared, so a group of copies costs its size,
not its square. The largest table of a task is the sets of one candidate component.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingspark.llm.common import store, text_slices
from ratingspark.llm.components import components
from ratingspark.llm.simhash_trie import SEED, Trie, unite

SHINGLE = 5
SIMILARITY = 0.8
BUDGET = 20
SMALL = 16
#: Counters of shingles, by the leading bits of their hash, and how many travel as one row.
COUNTER_BITS, SEGMENT = 22, 1 << 16
#: Block rows that are compared at a time.
CHUNK = 500_000


def shingle_set(text: str, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text; none for a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-shingle] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1:].tolist())], np.uint64))


def set_fingerprint(hashes: np.ndarray) -> int:
    """SimHash over distinct shingles."""
    counts = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 60_000):
        counts += np.unpackbits(hashes[part:part + 60_000].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def prefix_length(n: int, similarity: float = SIMILARITY) -> int:
    return n - int(np.ceil(similarity * n - 1e-9)) + 1 if n else 0


def _counters(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def _tally(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of the task have a shingle of each counter, in segments."""
    counts = np.zeros(1 << COUNTER_BITS, np.int32)
    for piece in text_slices(batches):
        for text in piece.column("text").to_pylist():
            np.add.at(counts, _counters(shingle_set(text)), 1)
    for number, part in enumerate(np.minimum(counts, 65_535).astype(np.uint16).reshape(-1, SEGMENT)):
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["segment", "counts"])


def _levels(table: pa.Table) -> pa.Table:
    """The sums of one segment on a logarithmic scale of 256 steps."""
    total = np.zeros(SEGMENT, np.int64)
    for row in table["counts"].to_pylist():
        total += np.frombuffer(row, np.uint16)
    levels = np.minimum(8 * np.log2(1 + total), 255).astype(np.uint8)
    return pa.table({"segment": table["segment"].slice(0, 1), "levels": pa.array([levels.tobytes()], pa.binary())})


def shingle_levels(docs: DataFrame):
    """A broadcast table of 4 MB: a step for each counter that grows with the texts that have a shingle of it."""
    context = docs.sparkSession.sparkContext
    tallies = docs.select("text").coalesce(context.defaultParallelism).mapInArrow(_tally, "segment int, counts binary")
    levels = bytearray(1 << COUNTER_BITS)
    for row in tallies.groupBy("segment").applyInArrow(_levels, "segment int, levels binary").collect():  # 64 rows
        levels[row.segment * SEGMENT:(row.segment + 1) * SEGMENT] = row.levels
    return context.broadcast(bytes(levels))


def _describe(similarity: float, table):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = np.frombuffer(table.value, np.uint8)
        for piece in text_slices(batches):
            ids, prints, sizes, prefixes = [], [], [], []
            for text in piece.column("text").to_pylist():
                hashes = shingle_set(text)
                ids.append(xxhash.xxh64_intdigest(hashes.tobytes(), SEED))
                prints.append(set_fingerprint(hashes))
                sizes.append(len(hashes))
                order = np.argsort(levels[_counters(hashes)], kind="stable")  # equal steps: by hash
                prefixes.append(hashes[order[:prefix_length(len(hashes), similarity)]].view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *prefixes])))
            signed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (ids, prints)]
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), piece.column("row_key"), *signed, pa.array(sizes, pa.int32()), keys],
                names=["doc_id", "row_key", "set_id", "fp", "n", "keys"])

    return run


def _find(parent: np.ndarray, at: int) -> int:
    while parent[at] != at:
        parent[at] = parent[parent[at]]
        at = parent[at]
    return at


def _roots(parent: np.ndarray) -> np.ndarray:
    while not np.array_equal(up := parent[parent], parent):
        parent = up
    return parent


def _possible(fp_a, n_a, fp_b, n_b, similarity: float, budget: int) -> np.ndarray:
    """Whether sizes and fingerprints leave room for the similarity."""
    low, high = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    return (low >= similarity * high - 1e-9) & ((low < SMALL) | (np.bitwise_count(fp_a ^ fp_b) <= budget))


def forest(fp: np.ndarray, n: np.ndarray, similarity: float, budget: int, same=None) -> np.ndarray:
    """Parents of a spanning forest of the possible pairs; ``same(i, j)`` confirms a pair if given."""
    parent = np.arange(len(fp))
    for i in range(len(fp) - 1):
        parent = _roots(parent)
        others = np.flatnonzero(parent[i + 1:] != parent[i]) + i + 1
        if not len(others) and (parent[i:] == parent[i]).all():
            break
        for j in others[_possible(fp[i], n[i], fp[others], n[others], similarity, budget)]:
            a, b = _find(parent, i), _find(parent, int(j))
            if a != b and (same is None or same(i, int(j))):
                parent[max(a, b)] = min(a, b)
    return _roots(parent)


def _tree(ids: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """The links of a forest by name."""
    child = np.flatnonzero(parent != np.arange(len(ids)))
    return np.column_stack([ids[child], ids[parent[child]]])


def _edges(pairs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["u", "v"])


def _block_links(similarity: float, budget: int):
    """Rows (key, set_id, fp, n) sorted by key and set_id: candidate links of each block's trie as a forest."""
    def links(key: np.ndarray, ids: np.ndarray, fp: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        begin = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
        length = np.diff(np.append(begin, len(key)))
        hub = np.repeat(begin, length)
        near = _possible(fp, n, fp[hub], n[hub], similarity, budget)
        whole = np.logical_and.reduceat(near, begin)
        rows = np.flatnonzero(np.repeat(whole, length) & (np.arange(len(key)) != hub))
        edges, seen, walked = [np.column_stack([ids[rows], ids[hub[rows]]])], set(), np.zeros(len(key), bool)
        for b, size in zip(begin[~whole].tolist(), length[~whole].tolist()):
            part = slice(b, b + size)
            if (name := ids[part].tobytes()) not in seen:
                seen.add(name)
                walked[part] = n[part] >= SMALL
                small = b + np.flatnonzero(similarity * n[part] < SMALL + 1e-9)
                if len(small) > 1:
                    edges.append(_tree(ids[small], forest(fp[small], n[small], similarity, budget)))
        rows = np.flatnonzero(walked)
        if len(rows):
            rows = rows[np.lexsort((fp[rows], hub[rows]))]
            ends = np.append(np.flatnonzero(np.diff(hub[rows])) + 1, len(rows))
            roots = np.column_stack([np.append(0, ends[:-1]), ends])
            parent = np.arange(len(rows))
            for i, j in Trie(fp[rows]).self_join(roots[roots[:, 1] - roots[:, 0] > 1], 0, budget):
                near = _possible(fp[rows[i]], n[rows[i]], fp[rows[j]], n[rows[j]], similarity, budget)
                unite(parent, i[near], j[near])
            edges.append(_tree(ids[rows], parent))
        return _edges(np.concatenate(edges))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0
        for batch in batches:
            key, ids, fp, n = (batch.column(c).to_numpy() for c in ("key", "set_id", "fp", "n"))
            held.append([key, ids, fp.view(np.uint64), n])
            rows += len(key)
            if rows >= CHUNK:
                parts = [np.concatenate(x) for x in zip(*held)]
                whole = np.searchsorted(parts[0], parts[0][-1])  # the last block may go on
                if whole:
                    yield links(*(p[:whole] for p in parts))
                held, rows = [[p[whole:] for p in parts]], len(parts[0]) - whole
        if rows:
            yield links(*(np.concatenate(x) for x in zip(*held)))

    return run


def _verify(similarity: float, budget: int):
    """Rows (root, set_id, fp, text) sorted by root and set_id: the links of similarity that hold, as forests."""
    def check(ids: list[int], fps: list[int], sets: list[np.ndarray]) -> np.ndarray:
        sizes = np.array([len(s) for s in sets])

        def same(i: int, j: int) -> bool:
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            return both >= similarity * (sizes[i] + sizes[j] - both) - 1e-9

        parent = forest(np.array(fps, np.int64).view(np.uint64), sizes, similarity, budget, same)
        return _tree(np.array(ids, np.int64), parent)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, ids, fps, sets = None, [], [], []
        for piece in text_slices(batches):
            edges = [np.zeros((0, 2), np.int64)]
            for r, i, fp, text in zip(*(piece.column(c).to_pylist() for c in ("root", "set_id", "fp", "text"))):
                if r != root:
                    edges.append(check(ids, fps, sets))
                    root, ids, fps, sets = r, [], [], []
                ids.append(i)
                fps.append(fp)
                sets.append(shingle_set(text))
            yield _edges(np.concatenate(edges))
        yield _edges(check(ids, fps, sets))

    return run


def describe(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Name, fingerprint, size and block keys of the shingle set of each row of ``docs``, stored."""
    levels = shingle_levels(docs)
    described = store(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "row_key", "text").mapInArrow(
        _describe(similarity, levels), "doc_id long, row_key long, set_id long, fp long, n int, keys array<long>"))
    levels.destroy()
    return described


def near_sets(docs: DataFrame, similarity: float = SIMILARITY, budget: int = BUDGET) -> DataFrame:
    """``doc_id``, ``row_key``, ``group`` of the rows of ``docs`` (doc_id, row_key, text; texts not null)."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    described = describe(docs, similarity)
    # The row of smallest key speaks for each distinct set.
    speaker = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row_key"))
    distinct = store(described.groupBy("set_id", "fp", "n").agg(speaker.alias("row"), F.first("keys").alias("keys")))
    blocks = distinct.select(F.explode("keys").alias("key"), "set_id", "fp", "n")
    candidates = store(blocks.repartition(n, "key").sortWithinPartitions("key", "set_id")
                       .mapInArrow(_block_links(similarity, budget), "u long, v long").distinct())
    roots = components(candidates)
    wanted = distinct.join(roots, distinct.set_id == roots.node) \
        .select("root", "set_id", "fp", F.col("row.doc_id").alias("_id"), F.col("row.row_key").alias("_key"))
    texts = docs.join(wanted, (F.col("row_key") == F.col("_key")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_id"))) \
        .select("root", "set_id", "fp", "text").dropDuplicates(["set_id"])
    links = store(texts.repartition(n, "root").sortWithinPartitions("root", "set_id")
                  .mapInArrow(_verify(similarity, budget), "u long, v long"))
    near = components(links)
    return described.select("doc_id", "row_key", "set_id").join(near, F.col("set_id") == F.col("node"), "left") \
        .select("doc_id", "row_key", F.coalesce("root", "set_id").alias("group"))


def keep_one_row(docs: DataFrame, similarity: float = SIMILARITY, budget: int = BUDGET) -> DataFrame:
    """The row of ``docs`` (doc_id, text and others) of smallest key in each group of near copies.

    The key of a row is its id (null ids last) and a hash of all its columns, so unrelated
    texts under one id both stay. Rows with null texts stay; empty texts are copies of each other.
    """
    keyed = docs.withColumn("_row", F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)))
    texts = keyed.filter("text is not null")
    groups = store(near_sets(texts.select("doc_id", F.col("_row").alias("row_key"), "text"), similarity, budget))
    smallest = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row_key")).alias("row")
    chosen = groups.groupBy("group").agg(smallest).select(F.col("row.doc_id").alias("_id"), F.col("row.row_key").alias("_key"))
    kept = texts.join(chosen, (F.col("_row") == F.col("_key")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_id")), "left_semi")
    if groups.groupBy("doc_id", "row_key").count().filter("count > 1").limit(1).collect():
        kept = kept.dropDuplicates(["doc_id", "_row"])
    return kept.drop("_row").unionByName(docs.filter("text is null"))
