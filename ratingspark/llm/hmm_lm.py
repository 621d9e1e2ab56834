"""Hidden Markov language model: Baum-Welch counts over all training text, exact scores by scaled forward recursion.

Texts are lower-cased (A-Z), cut into words at ASCII white space and closed by one
end token. The model has ``states`` hidden states. A state emits a *symbol*: the end,
one of the ``symbols`` most frequent words, or one of ``buckets`` hash classes of all
other words; a word of a class is then drawn by its own count,
(c + 1) / (C + V + 1) with the class's C tokens and V words, the last 1 for words never
seen. So every text has a proper probability, yet the emission table has a fixed size.

1. Word counts of all training documents: each task counts before the shuffle.
2. One pass encodes every text as symbols (16 bits each) with its share of the score
   from the ``head`` most frequent words, whose counts are sent to the tasks; its
   rarer words are kept by name. This table is written once, and later passes read it.
3. Baum-Welch: each round every task runs the scaled forward and backward
   recursions over its documents, all documents of a slice in step, and adds expected
   counts up before the shuffle. The driver gets the sums: ``symbols + buckets`` rows.
   All training text is used in every round.
4. The forward recursion over all documents gives their exact likelihood. Rarer words
   are joined to the counts by word; that join adds to the score and to the base.

What is sent to tasks is bounded by ``head``, ``symbols``, ``buckets`` and ``states``;
counts of rarer words are never collected. Rows are known by a number given
when the encoded table is written, so ids may repeat or be null (a null id has
the remainder of empty text). Null and empty texts consist of the end token. With
nothing to train on, the table of counts is empty and all words are unknown.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingspark.llm.common import documents, remainder, store, text_slices

#: The end token in the table of counts; no word is empty.
END = b""
HELD_OUT = 2


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


@dataclass(frozen=True)
class Cut:
    """The tokens of some texts: ``codes`` are places in ``words``, place 0 is the end."""

    words: list[bytes]
    codes: np.ndarray
    lengths: np.ndarray  # tokens of each text

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.lengths)), self.lengths)


def cut(texts: pa.Array) -> Cut:
    """The same tokens as ``tokens`` finds, of many texts at once."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = lists.flatten()
    real = pc.greater(pc.binary_length(words), 0)
    owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())[real.to_numpy(zero_copy_only=False)]
    known = words.filter(real).dictionary_encode()
    lengths = np.bincount(owner, minlength=len(lists)) + 1
    inner = np.ones(lengths.sum(), bool)
    inner[np.cumsum(lengths) - 1] = False
    codes = np.zeros(len(inner), np.int32)
    codes[inner] = known.indices.to_numpy() + 1
    return Cut([END, *known.dictionary.cast(pa.binary()).to_pylist()], codes, lengths)


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in text_slices(batches, limit=16_000_000):
        found = cut(piece.column("text"))
        yield pa.RecordBatch.from_arrays([pa.array(found.words, pa.binary()), pa.array(np.bincount(found.codes, minlength=len(found.words)))], names=["word", "n"])


@dataclass(frozen=True)
class Counts:
    """What tasks know of the counts: totals, the most frequent words, sums of the classes."""

    n_tokens: int
    n_words: int
    words: list[bytes]
    counts: np.ndarray
    n_symbols: int  # the first of ``words`` have a symbol of their own; the end is one of them
    class_tokens: np.ndarray
    class_words: np.ndarray

    @property
    def size(self) -> int:
        return self.n_symbols + len(self.class_tokens)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1) / (self.n_tokens + self.n_words + 1))

    def symbol(self, word: bytes) -> int:
        """Symbol of a word that has none of its own."""
        return self.n_symbols + zlib.crc32(word) % len(self.class_tokens)


def count_words(training: DataFrame, head: int = 150_000, symbols: int = 60_000, buckets: int = 4_096) -> tuple[DataFrame, Counts]:
    """The stored table of all counts (word, n), and the bounded part that tasks need: ``head`` words at most."""
    if symbols + buckets > 1 << 16:
        raise ValueError("symbols and buckets together are 65,536 at most: encoded texts hold 16 bits for each")
    table = store(training.select("text").mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    totals = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    # Words by size class of their count: whole classes from the top, ``head`` words at most.
    size = F.floor(F.log2("n") * 16)
    least, taken = math.inf, 0
    for row in sorted(table.groupBy(size.alias("size")).count().collect(), key=lambda r: -r["size"]):
        if (taken := taken + row["count"]) > head:
            break
        least = row["size"]
    top = [] if least == math.inf else table.filter(size >= F.lit(least)).collect()
    found = {bytes(r["word"]): r["n"] for r in top}
    if END not in found:
        found[END] = table.filter(F.length("word") == 0).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # The end is the first symbol; then the most frequent words.
    words = sorted(found, key=lambda w: (w != END, -found[w], w))
    counts = np.array([found[w] for w in words], np.int64)
    n_symbols = min(symbols, len(words))
    sums = table.groupBy((F.crc32("word") % buckets).cast("int").alias("class")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    class_tokens, class_words = np.zeros(buckets), np.zeros(buckets)
    for r in sums:
        class_tokens[r["class"]], class_words[r["class"]] = r["n"], r["v"]
    for word, n in zip(words[:n_symbols], counts):
        if n:
            class_tokens[zlib.crc32(word) % buckets] -= n
            class_words[zlib.crc32(word) % buckets] -= 1
    return table, Counts(totals["n"], totals["v"], words, counts, n_symbols, class_tokens, class_words)


def _encode(known: Counts):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                        ("base", pa.float64()), ("within", pa.float64()), ("symbols", pa.binary()),
                        ("rare", pa.list_(pa.binary())), ("times", pa.list_(pa.int32()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {w: i for i, w in enumerate(known.words)}
        symbol = np.array([i if i < known.n_symbols else known.symbol(w) for i, w in enumerate(known.words)], np.int64)
        base = known.base(known.counts)
        kind = np.maximum(symbol - known.n_symbols, 0)
        within = np.where(symbol < known.n_symbols, 0.0, np.log10((known.counts + 1) / (known.class_tokens[kind] + known.class_words[kind] + 1)))
        for piece in text_slices(batches, limit=8_000_000):
            found = cut(piece.column("text"))
            at = np.fromiter(map(place.get, found.words, repeat(-1)), np.int64, len(found.words))
            unknown = at < 0
            codes = np.where(unknown, 0, symbol[at]) if len(symbol) else np.zeros(len(at), np.int64)
            codes[unknown] = [known.symbol(found.words[i]) for i in np.flatnonzero(unknown).tolist()]
            owner, n = found.owner, len(found.lengths)

            def sums(values: np.ndarray) -> np.ndarray:
                """Totals by text of a value of each word, nothing for rarer words."""
                return np.bincount(owner, np.where(unknown, 0, values[at])[found.codes], n)

            rare = unknown[found.codes]
            pairs, times = np.unique(owner[rare] * len(at) + found.codes[rare], return_counts=True)
            names = pa.array(found.words, pa.binary()).take(pa.array(pairs % len(at)))
            begins = pa.array(np.searchsorted(pairs, np.arange(n + 1) * len(at)), pa.int32())
            flat = codes[found.codes].astype(np.uint16)
            ends = np.append(0, np.cumsum(found.lengths) * flat.itemsize).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                piece.column("doc_id"), piece.column("held_out"), pa.array(found.lengths), pa.array(sums(known.counts > 0).astype(np.int64)),
                pa.array(sums(base)), pa.array(sums(within)), pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(flat)]),
                pa.ListArray.from_arrays(begins, names), pa.ListArray.from_arrays(begins, pa.array(times, pa.int32()))], schema=schema)

    return run


def encode(docs: DataFrame, known: Counts) -> DataFrame:
    """The stored table of encoded texts; ``docs`` has doc_id, held_out, text."""
    encoded = docs.select(F.col("doc_id").cast("long"), "held_out", "text").mapInArrow(
        _encode(known), "doc_id long, held_out boolean, n_tokens long, n_known long, base double, within double, "
        "symbols binary, rare array<binary>, times array<int>")
    return store(encoded.withColumn("row", F.monotonically_increasing_id()))


@dataclass(frozen=True)
class Model:
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # symbols x states


def first_model(known: Counts, states: int) -> Model:
    """Persistent states whose emissions are the word frequencies, tilted by a hash of (symbol, state)."""
    weight = np.concatenate([known.counts[:known.n_symbols], known.class_tokens]).astype(float) + 1
    mixed = (np.arange(known.size, dtype=np.uint64)[:, None] * np.uint64(states) + np.arange(states, dtype=np.uint64)) + np.uint64(1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    tilt = (mixed >> np.uint64(40)).astype(float) / 2**24
    emit = weight[:, None] * np.exp(tilt)
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


class Slice:
    """Documents in step: position by position, longest first, so those still running are a prefix."""

    def __init__(self, rows: list[bytes]):
        codes = [np.frombuffer(r, np.uint16) for r in rows]
        lengths = np.array([len(c) for c in codes], np.int64)
        self.order = np.argsort(-lengths, kind="stable")
        lengths = lengths[self.order]
        steps = int(lengths[0]) if len(lengths) else 0
        self.running = np.searchsorted(-lengths, -np.arange(steps), "left")  # documents longer than t
        self.begin = np.append(0, np.cumsum(self.running))
        position = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        flat = self.begin[position] + np.repeat(np.arange(len(lengths)), lengths)
        self.codes = np.empty(lengths.sum(), np.int64)
        self.codes[flat] = np.concatenate([codes[i] for i in self.order]) if len(lengths) else []
        self.flat, self.owner = flat, np.repeat(self.order, lengths)

    def forward(self, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scaled forward variables, scales, and emissions, of each position."""
        emit = model.emit[self.codes]
        alpha = np.empty_like(emit)
        scale = np.empty(len(emit))
        begin, running = self.begin.tolist(), self.running.tolist()
        for t, n in enumerate(running):
            now = slice(begin[t], begin[t] + n)
            a = alpha[now]
            if t:
                np.matmul(alpha[begin[t - 1]:begin[t - 1] + n], model.move, out=a)
                a *= emit[now]
            else:
                np.multiply(model.start, emit[now], out=a)
            s = scale[now]
            np.sum(a, axis=1, out=s)
            a /= s[:, None]
        return alpha, scale, emit

    def log_likelihood(self, scale: np.ndarray) -> np.ndarray:
        """log10 of the probability of each row, in the given order."""
        return np.bincount(self.owner, np.log10(scale)[self.flat], len(self.order))

    def expected(self, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected counts: emissions (symbols x states), moves, starts; and the log likelihood."""
        alpha, scale, emit = self.forward(model)
        emit /= scale[:, None]
        beta = np.ones_like(alpha)
        begin, running = self.begin.tolist(), self.running.tolist()
        back = np.ascontiguousarray(model.move.T)
        for t in range(len(running) - 1, 0, -1):
            later = slice(begin[t], begin[t] + running[t])
            emit[later] *= beta[later]
            np.matmul(emit[later], back, out=beta[begin[t - 1]:begin[t - 1] + running[t]])
        later = np.arange(begin[1] if len(begin) > 1 else 0, len(alpha))
        before = later - np.repeat(self.running[:-1], self.running[1:])
        moves = model.move * (alpha[before].T @ emit[later])
        beta *= alpha  # now the posterior of each state
        emissions = np.stack([np.bincount(self.codes, beta[:, k], len(model.emit)) for k in range(beta.shape[1])], axis=1)
        return emissions, moves, beta[:len(self.order)].sum(axis=0), float(np.log10(scale).sum())


def _like_lengths(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows cut by size, those of like length together: steps that only a few long documents take are then rare."""
    for batch in batches:
        yield from text_slices([batch.take(pc.array_sort_indices(pc.binary_length(batch.column("symbols"))))], "symbols", limit=1_000_000)


def _expect(model: Model):
    states = len(model.start)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows: symbols, then moves of each state, starts, and the likelihood.
        total = np.zeros((len(model.emit) + states + 2, states))
        used = False
        for piece in _like_lengths(batches):
            emissions, moves, starts, likelihood = Slice(piece.column("symbols").to_pylist()).expected(model)
            total[:len(emissions)] += emissions
            total[len(emissions):-2] += moves
            total[-2] += starts
            total[-1, 0] += likelihood
            used = True
        if used:
            rows = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows), *(pa.array(total[rows, k]) for k in range(states))], names=["item", *(f"s{k}" for k in range(states))])

    return run


def baum_welch(encoded: DataFrame, known: Counts, states: int = 6, rounds: int = 5, prior: float = 1.0) -> tuple[Model, list[float]]:
    """Train on the rows of ``encoded`` that are not held out; also the log likelihood before each round.

    ``prior`` tokens of the overall word frequencies are added to each state.
    """
    model, history = first_model(known, states), []
    weight = np.concatenate([known.counts[:known.n_symbols], known.class_tokens]).astype(float) + 1
    weight /= weight.sum()
    names = [f"s{k}" for k in range(states)]
    training = encoded.filter(~F.col("held_out")).select("symbols")
    for _ in range(rounds):
        sums = training.mapInArrow(_expect(model), "item long, " + ", ".join(f"{n} double" for n in names)) \
            .groupBy("item").agg(*(F.sum(n).alias(n) for n in names)).collect()
        if not sums:
            break
        total = np.zeros((known.size + states + 2, states))
        for row in sums:
            total[row["item"]] = [row[n] for n in names]
        history.append(total[-1, 0])
        emit = total[:known.size] + prior * known.size * weight[:, None]
        move = total[known.size:-2] + 0.1
        start = total[-2] + 0.1
        model = replace(model, emit=emit / emit.sum(axis=0), move=move / move.sum(axis=1, keepdims=True), start=start / start.sum())
    return model, history


def _likelihood(model: Model):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _like_lengths(batches):
            part = Slice(piece.column("symbols").to_pylist())
            found = part.log_likelihood(part.forward(model)[1])
            names = [c for c in piece.schema.names if c != "symbols"]
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in names), pa.array(found)], names=[*names, "likelihood"])

    return run


def score(encoded: DataFrame, table: DataFrame, known: Counts, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every encoded row."""
    spark = encoded.sparkSession
    kept = encoded.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "within", "symbols")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema if f.name != "symbols")
    scored = kept.mapInArrow(_likelihood(model), f"{fields}, likelihood double")
    buckets = len(known.class_tokens)
    classes = spark.createDataFrame(
        [(i, float(t + v + 1)) for i, (t, v) in enumerate(zip(known.class_tokens, known.class_words))], "class int, mass double")
    rare = encoded.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
    c = F.coalesce("n", F.lit(0))
    priced = rare.join(table, "word", "left") \
        .withColumn("class", (F.crc32("word") % buckets).cast("int")).join(F.broadcast(classes), "class") \
        .groupBy("row").agg(
            F.sum(F.col("times") * F.log10((c + 1) / F.lit(float(known.n_tokens + known.n_words + 1)))).alias("rare_base"),
            F.sum(F.col("times") * F.log10((c + 1) / F.col("mass"))).alias("rare_within"),
            F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    zero = F.lit(0.0)
    return scored.join(priced, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(known.n_tokens).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("rare_base", zero)).alias("base_score"),
        (F.col("likelihood") + F.col("within") + F.coalesce("rare_within", zero)).alias("score"))


def op1_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", (remainder(F.col("doc_id"), 7) == HELD_OUT).alias("held_out"))
    table, known = count_words(docs.filter(~F.col("held_out")))
    encoded = encode(docs, known)
    model, _ = baum_welch(encoded, known)
    return score(encoded, table, known, model)
