r"""Phrase collocation mining: phrases counted in HAT-tries, scored by their weakest cut.

Texts are lower-cased (A-Z), split at ``[.,;:!?\x0A-\x0D]`` into pieces and these at blanks and
tabs into words. A phrase is some contiguous words of a piece. Everything is counted per
language.

1. A task counts in a HAT-trie: words have ids of the task; phrases are kept in hash
   containers that hold the ids still to go. A container of more than ``BURST`` entries bursts into a trie
   node with one container for each next word, so the trie stays shallow and only busy
   prefixes have nodes. Beyond ``LIMIT`` entries the largest subtrees are spilled whole, as runs
   sorted by their words, until half is left.
2. A run is cut by prefix partition, a hash of language and first two words, so that one busy word does not
   end up in one task. Each cut, of all languages, travels as one compressed Arrow block. The blocks of a
   prefix partition are merged by adding up equal phrases, some million entries at a time, and
   only phrases that occur often enough leave the task.
3. Words and pairs are counted first. A longer phrase is counted where both phrases of one word less are
   in a Bloom filter of those found often enough. The filter's size is bounded (32 MB); false
   positives only add work, and every count is exact.
4. Counts of both sides of each cut are joined to the candidates once, in long form.

A null text has no words, a null language is ``und``. Repeated rows count repeatedly. Empty
tables give no rows. Only the named columns are read, so further columns may have any name. A very long text is one row of a task,
which holds its words once.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratingspark.llm.common import discard, documents, store, text_slices

#: Entries of a container that has a level below; entries of all tries of a task; words with ids.
BURST, LIMIT, WORDS = 4_096, 500_000, 400_000
#: The Bloom filter: bits for each phrase, at most 2^28 bits, probes.
BITS, MOST_BITS, PROBES = 16, 1 << 28, 4
#: Words of 64 bits of the filter that travel to the driver as one row.
SEGMENT = 1 << 15
#: A row of the shuffle: the batches of ``block`` hold the phrases of one language and length each.
BLOCKS = "bucket long, langs array<string>, words array<int>, block binary"
#: Prefix partitions for each partition of the shuffle; entries that are merged at once.
FINER, HELD = 4, 2_000_000
COUNTS = "lang string, phrase string, words int, f long"

_SEPARATOR = b"\xff"  # no byte of UTF-8
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + _SEPARATOR * 10)


def tokens(texts: list[bytes | None]) -> list[bytes]:
    """Words of all texts, with separators between pieces."""
    joined = _SEPARATOR.join(t for t in texts if t).translate(_TABLE)
    return joined.replace(_SEPARATOR, b" " + _SEPARATOR + b" ").split()


class _Node:
    """A trie node that a container has burst into: next word's id (4 bytes) -> what follows."""

    __slots__ = ("children",)

    def __init__(self, container: dict[bytes, int]):
        self.children: dict[bytes, _Node | dict[bytes, int]] = defaultdict(dict)
        for key, count in container.items():
            self.children[key[:4]][key[4:]] = count


class HatTrie:
    """Counts of phrases of one length, given as rows of word ids."""

    def __init__(self, burst: int = BURST):
        self.root: _Node | dict[bytes, int] = {}
        self.burst, self.size = burst, 0

    def add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        """Rows of ids, sorted, and how often each occurs."""
        self.root = self._add(self.root, np.ascontiguousarray(ids, ">u4"), counts)

    def _add(self, node, ids: np.ndarray, counts: np.ndarray):
        if isinstance(node, _Node):
            heads = ids[:, 0]
            cuts = np.flatnonzero(np.concatenate([[True], heads[1:] != heads[:-1], [True]])).tolist()
            names = _keys(ids[cuts[:-1], :1])
            rest = np.ascontiguousarray(ids[:, 1:])
            keys, numbers = _keys(rest), counts.tolist()
            for name, a, b in zip(names, cuts, cuts[1:]):
                child = node.children[name]
                if isinstance(child, _Node):
                    self._add(child, rest[a:b], counts[a:b])
                else:
                    self._fill(child, keys[a:b], numbers[a:b])
                    if len(child) > self.burst and rest.shape[1] > 1:
                        node.children[name] = _Node(child)
            return node
        self._fill(node, _keys(ids), counts.tolist())
        return _Node(node) if len(node) > self.burst and ids.shape[1] > 1 else node

    def _fill(self, container: dict[bytes, int], keys: list[bytes], counts: list[int]) -> None:
        before = len(container)
        for key, count in zip(keys, counts):
            container[key] = container.get(key, 0) + count
        self.size += len(container) - before

    def take(self, keep: int) -> Iterator[tuple[bytes, _Node | dict[bytes, int]]]:
        """Remove the largest subtrees, until ``keep`` entries or fewer are left: (ids so far, subtree)."""
        if not isinstance(self.root, _Node) or keep == 0:
            root, self.root, self.size = self.root, {}, 0
            yield b"", root
            return
        sizes = sorted(((_size(child), name) for name, child in self.root.children.items()), reverse=True)
        for size, name in sizes:
            if self.size <= keep:
                return
            self.size -= size
            yield name, self.root.children.pop(name)


def _keys(ids: np.ndarray) -> list[bytes]:
    return np.ascontiguousarray(ids).view(f"V{4 * ids.shape[1]}").ravel().tolist()


def _size(node) -> int:
    return sum(map(_size, node.children.values())) if isinstance(node, _Node) else len(node)


def _entries(prefix: bytes, node, keys: list[bytes], counts: list[int]) -> None:
    if isinstance(node, _Node):
        for name, child in node.children.items():
            _entries(prefix + name, child, keys, counts)
    else:
        keys.extend([prefix + key for key in node])
        counts.extend(node.values())


def distinct_phrases(ids: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows ``ids[s:s+n]``, sorted, and how often each occurs."""
    code = ids[starts]
    for step in range(1, n):
        if step > 1:
            code = np.unique(code, return_inverse=True)[1]
        code = code << 32 | ids[starts + step]
    _, first, counts = np.unique(code, return_index=True, return_counts=True)
    return ids[starts[first][:, None] + np.arange(n)], counts


def phrase_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each n words in a row, from their hashes."""
    last = len(words) - n + 1
    out = np.zeros(max(last, 0), np.uint64)
    for step in range(n if last > 0 else 0):
        out = (out ^ words[step:step + last]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _probes(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    step = hashes >> np.uint64(32) | np.uint64(1)
    return [(hashes + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(PROBES)]


def _holds(bloom: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    found = np.ones(len(hashes), bool)
    for at in _probes(hashes, 64 * len(bloom)):
        found &= (bloom[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return found


class _Counter:
    """The tries of a task, one for each language and phrase length, over one table of word ids."""

    def __init__(self, limit: int, burst: int, bloom: np.ndarray | None, buckets: int):
        self.limit, self.burst, self.bloom, self.buckets = limit, burst, bloom, buckets
        self.tries: dict[tuple[str, int], HatTrie] = {}
        self.totals: dict[str, int] = defaultdict(int)
        self.clear()

    def clear(self) -> None:
        self.ids: dict[bytes, int] = defaultdict()
        self.ids.default_factory = self.ids.__len__
        self.ids[_SEPARATOR]
        self.hashes = np.zeros(0, np.uint64)

    def count(self, lang: str, texts: list[bytes | None], sizes: list[int]) -> None:
        found = np.fromiter(map(self.ids.__getitem__, tokens(texts)), np.int64)
        word = found > 0
        self.totals[lang] += int(word.sum())
        if len(self.ids) > len(self.hashes):
            names = list(self.ids)[len(self.hashes):]
            self.hashes = np.concatenate([self.hashes, np.array([xxhash.xxh3_64_intdigest(w) for w in names], np.uint64)])
        for n in sizes:
            last = len(found) - n + 1
            if last < 1:
                continue
            whole = np.logical_and.reduce([word[k:k + last] for k in range(n)])
            if self.bloom is not None:
                salted = self.hashes[found] ^ np.uint64(xxhash.xxh3_64_intdigest(lang))
                often = _holds(self.bloom, phrase_hashes(salted, n - 1))
                whole &= often[:last] & often[1:last + 1]
            starts = np.flatnonzero(whole)
            if len(starts):
                trie = self.tries.setdefault((lang, n), HatTrie(self.burst))
                trie.add(*distinct_phrases(found, starts, n))

    def spill(self, everything: bool = False) -> Iterator[pa.RecordBatch]:
        """Sorted runs of whole subtrees, the largest first, if the tries are full."""
        size = sum(t.size for t in self.tries.values())
        full = len(self.ids) > WORDS
        if not (everything or full or size > self.limit):
            return
        names = pa.array(list(self.ids), pa.binary())
        rank = np.empty(len(self.ids), np.int64)
        rank[pa.compute.sort_indices(names).to_numpy()] = np.arange(len(self.ids))
        runs: dict[int, list[tuple[str, int, pa.RecordBatch]]] = defaultdict(list)
        for (lang, n), trie in self.tries.items():
            keys: list[bytes] = []
            counts: list[int] = []
            for prefix, node in trie.take(0 if everything or full else trie.size // 2):
                _entries(prefix, node, keys, counts)
            if keys:
                ids = np.frombuffer(b"".join(keys), ">u4").reshape(-1, n).astype(np.int64)
                del keys
                buckets = (_prefix_hashes(lang, self.hashes, ids) % np.uint64(self.buckets)).astype(np.int64)
                for bucket, run in _runs(names, rank, ids, np.array(counts, np.int64), buckets):
                    runs[bucket].append((lang, n, run))
        if everything:
            for lang, total in self.totals.items():
                runs[0].append((lang, 0, pa.RecordBatch.from_arrays([pa.array([b""], pa.binary()), pa.array([total], pa.int64())], names=["phrase", "f"])))
        if runs:
            yield _blocks(runs)
        if everything or full:
            self.tries.clear()
            self.clear()


def _prefix_hashes(lang: str, hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    salt = np.uint64(xxhash.xxh3_64_intdigest(lang))
    if ids.shape[1] == 1:
        return phrase_hashes(hashes[ids[:, 0]] ^ salt, 1)
    return _two(hashes[ids[:, :2]] ^ salt)


def _two(hashes: np.ndarray) -> np.ndarray:
    """``phrase_hashes`` of many pairs at once."""
    return phrase_hashes(np.ascontiguousarray(hashes).ravel(), 2)[::2]


def _runs(names: pa.Array, rank: np.ndarray, ids: np.ndarray, counts: np.ndarray, buckets: np.ndarray) -> Iterator[tuple[int, pa.RecordBatch]]:
    """A sorted run of each prefix partition."""
    order = np.lexsort((*rank[ids].T[::-1], buckets))
    ids, buckets = ids[order], buckets[order]
    columns = [names.take(pa.array(ids[:, k])) for k in range(ids.shape[1])]
    phrases = pa.compute.binary_join_element_wise(*columns, pa.scalar(b" ")) if len(columns) > 1 else columns[0]
    run = pa.RecordBatch.from_arrays([phrases, pa.array(counts[order])], names=["phrase", "f"])
    cuts = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1], [True]])).tolist()
    for a, b in zip(cuts, cuts[1:]):
        yield int(buckets[a]), run.slice(a, b - a)


def _blocks(runs: dict[int, list[tuple[str, int, pa.RecordBatch]]]) -> pa.RecordBatch:
    options = pa.ipc.IpcWriteOptions(compression="lz4")
    blocks = []
    for parts in runs.values():
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, parts[0][2].schema, options=options) as writer:
            for *_, run in parts:
                writer.write_batch(run)
        blocks.append(sink.getvalue().to_pybytes())
    return pa.RecordBatch.from_arrays([
        pa.array(list(runs), pa.int64()), pa.array([[p[0] for p in parts] for parts in runs.values()], pa.list_(pa.string())),
        pa.array([[p[1] for p in parts] for parts in runs.values()], pa.list_(pa.int32())), pa.array(blocks, pa.binary())],
        names=["bucket", "langs", "words", "block"])


def _count(sizes: list[int], bloom, limit: int, burst: int, buckets: int):
    """Blocks of runs of phrases of these lengths; those of no words hold the number of words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(limit, burst, None if bloom is None else np.frombuffer(bloom.value, np.uint64), buckets)
        for piece in text_slices(batches):
            by_lang: dict[str, list] = defaultdict(list)
            for lang, text in zip(piece.column("lang").to_pylist(), piece.column("text").cast(pa.binary()).to_pylist()):
                by_lang[lang].append(text)
            for lang, texts in by_lang.items():
                counter.count(lang, texts, sizes)
            yield from counter.spill()
        yield from counter.spill(everything=True)

    return run


def _add_up(runs: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(runs).group_by("phrase", use_threads=False).aggregate([("f", "sum")]).rename_columns(["phrase", "f"])


def _merge(min_count: int):
    """Blocks ordered by bucket: each phrase of at least ``min_count`` with the sum of its counts."""

    def finish(held: dict[tuple[str, int], list[pa.Table]]) -> Iterator[pa.RecordBatch]:
        for (lang, words), runs in held.items():
            rows = _add_up(runs)
            rows = rows.filter(pa.compute.greater_equal(rows["f"], min_count if words else 0))
            if rows.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * rows.num_rows), rows["phrase"].combine_chunks().cast(pa.string(), safe=False),
                     pa.array([words] * rows.num_rows, pa.int32()), rows["f"].combine_chunks()], names=["lang", "phrase", "words", "f"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, size, most = None, 0, HELD
        held: dict[tuple[str, int], list[pa.Table]] = defaultdict(list)
        for batch in batches:
            blocks = batch.column("block")
            for row, (bucket, langs, words) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("bucket", "langs", "words")))):
                if bucket != current:
                    yield from finish(held)
                    held.clear()
                    current, size, most = bucket, 0, HELD
                for lang, n, part in zip(langs, words, pa.ipc.open_stream(blocks[row].as_buffer())):
                    held[lang, n].append(pa.Table.from_batches([part]))
                    size += part.num_rows
                if size > most:
                    held = defaultdict(list, {key: [_add_up(runs)] for key, runs in held.items()})
                    size = sum(runs[0].num_rows for runs in held.values())
                    most = HELD + 2 * size
        yield from finish(held)

    return run


def count_phrases(docs: DataFrame, sizes: list[int], min_count: int, bloom=None, limit: int = LIMIT, burst: int = BURST) -> DataFrame:
    """(lang, phrase, words, f) of the phrases of these lengths that occur often enough; ``docs`` has lang and text.

    A row of no words for each language has its number of words.
    """
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = docs.mapInArrow(_count(sizes, bloom, limit, burst, FINER * width), BLOCKS)
    return blocks.repartition(width, "bucket").sortWithinPartitions("bucket").mapInArrow(_merge(min_count), COUNTS)


def _positions(n: int, bits: int):
    """Bits of the Bloom filter that the phrases set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [p.split(b" ") for p in batch.column("phrase").cast(pa.binary()).to_pylist()]
            salts = np.array([xxhash.xxh3_64_intdigest(x) for x in batch.column("lang").to_pylist()], np.uint64)
            hashes = np.array([xxhash.xxh3_64_intdigest(w) for p in words for w in p], np.uint64).reshape(-1, n)
            hashes = np.concatenate([phrase_hashes(row, n) for row in hashes ^ salts[:, None]]) if n != 2 else \
                _two(hashes ^ salts[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(_probes(hashes, bits)).astype(np.int64))], names=["at"])

    return run


def bloom_segments(phrases: DataFrame, n: int, bits: int) -> DataFrame:
    """(segment, bits): the filter in pieces of ``SEGMENT`` words of 64 bits, put together by the tasks; empty ones are left out."""
    width = min(SEGMENT, bits // 64)

    def build(table: pa.Table) -> pa.Table:
        piece = np.zeros(width, np.int64)
        word = table["word"].to_numpy()
        piece[word % width] = table["mask"].to_numpy()
        return pa.table({"segment": pa.array([int(word[0]) // width], pa.int32()), "bits": pa.array([piece.tobytes()], pa.binary())})

    at = phrases.mapInArrow(_positions(n, bits), "at long")
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("mask"))
    return words.groupBy((F.col("word") / F.lit(width)).cast("int")).applyInArrow(build, "segment int, bits binary")


def bloom_filter(phrases: DataFrame, n: int):
    """A broadcast filter that holds the hashes of all ``phrases`` (lang, phrase) of n words."""
    spark = phrases.sparkSession
    bits = 1 << 16
    wanted = min(MOST_BITS, BITS * phrases.count())
    while bits < wanted:
        bits *= 2
    bloom = bytearray(bits // 8)
    for row in bloom_segments(phrases, n, bits).collect():  # at most 32 MB
        bloom[row.segment * 8 * SEGMENT:row.segment * 8 * SEGMENT + len(row.bits)] = row.bits
    return spark.sparkContext.broadcast(bytes(bloom))


def _long(count: F.Column) -> F.Column:
    return count.cast("decimal(19,0)")


def score(counts: DataFrame, cover: int) -> DataFrame:
    """Candidates with their lowest-scoring cut, without those that a longer one covers.

    ``counts`` holds (lang, words, phrase, f) of all phrases that occur often enough.
    """
    parts = F.split("phrase", " ")
    cuts = counts.filter("words > 1").select(
        "lang", "phrase", "words", F.col("f").alias("a"), parts.alias("p"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    sides = cuts.select("lang", "phrase", "words", "a", "k", F.explode(F.array(
        F.struct(F.lit(0).alias("right"), F.array_join(F.slice("p", 1, F.col("k")), " ").alias("part")),
        F.struct(F.lit(1).alias("right"), F.array_join(F.slice("p", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("part")))).alias("side"),
    ).select("*", "side.right", "side.part").drop("side")
    known = counts.select("lang", F.col("phrase").alias("part"), "f")
    cut = sides.join(known, ["lang", "part"]).groupBy("lang", "phrase", "words", "a", "k").agg(
        F.max(F.when(F.col("right") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("right") == 1, F.col("f"))).alias("r"))
    million = F.lit(1_000_000).cast("decimal(7,0)")
    scored = cut.select("*", (million * (_long(F.col("a")) * _long(F.col("a")))).alias("top"), (_long(F.col("l")) * _long(F.col("r"))).alias("below")) \
        .withColumn("score", F.expr("top div below"))
    best = scored.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    inner = counts.filter("words > 2").select("lang", "f", F.split("phrase", " ").alias("p"), "words").select("lang", "f", F.explode(F.array(
        F.array_join(F.slice("p", 1, F.col("words") - 1), " "), F.array_join(F.slice("p", 2, F.col("words") - 1), " "))).alias("phrase"))
    covered = inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    return best.join(covered, ["lang", "phrase"], "left").filter(
        F.coalesce(100 * _long(F.col("longer")) < cover * _long(F.col("a")), F.lit(True))).select("lang", "phrase", "a", "c.l", "c.r", "c.score")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", longest: int = 3, min_count: int = 10, top: int = 2_000,
                 cover: int = 50, limit: int = LIMIT, burst: int = BURST) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    source = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    tables = [store(count_phrases(source, [1, 2], min_count, None, limit, burst))]
    n_words = tables[0].filter("words = 0").select("lang", F.col("f").alias("n"))
    counts = tables[0].filter("words > 0")
    for n in range(3, longest + 1):
        bloom = bloom_filter(counts.filter(F.col("words") == n - 1), n - 1)
        tables.append(store(count_phrases(source, [n], min_count, bloom, limit, burst).filter("words > 0")))
        counts = counts.unionByName(tables[-1])
        bloom.destroy()
    scored = score(counts, cover).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    near = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    best = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    done = store(best.join(n_words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
    for table in tables:
        discard(table)
    return done


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir).select("lang", "text"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)
), spots AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces WHERE len(w) > 0
), phrases AS (
  SELECT lang, k AS words, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM spots, (VALUES (1), (2), (3)) v(k) WHERE i + k - 1 <= len(w)
), counts AS (
  SELECT lang, words, phrase, count(*) AS f FROM phrases GROUP BY ALL
), sizes AS (
  SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE words = 1 GROUP BY lang
), often AS (
  SELECT * FROM counts WHERE f >= 10
), cuts AS (
  SELECT lang, words, phrase, f, k, array_to_string(p[1:k], ' ') AS lp, array_to_string(p[k + 1:], ' ') AS rp
  FROM (SELECT *, string_split(phrase, ' ') AS p FROM often WHERE words > 1), (VALUES (1), (2)) v(k) WHERE k < words
), scored AS (
  SELECT c.lang, c.words, c.phrase, c.f AS a, k, x.f AS l, y.f AS r, (1000000::HUGEINT * c.f * c.f // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN often x ON x.lang = c.lang AND x.phrase = c.lp JOIN often y ON y.lang = c.lang AND y.phrase = c.rp
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, unnest([array_to_string(p[1:2], ' '), array_to_string(p[2:3], ' ')]) AS phrase, f
  FROM (SELECT *, string_split(phrase, ' ') AS p FROM often WHERE words = 3)
), covered AS (
  SELECT lang, phrase, max(f) AS longer FROM inside GROUP BY ALL
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best LEFT JOIN covered USING (lang, phrase) JOIN sizes USING (lang)
WHERE coalesce(100 * longer < 50 * a, true)
QUALIFY rank <= 2000
"""
