"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexical transducer maps each word to a class: insult, threat, target, negation,
reporting, other. It is composed with transducers that mark what they have read:

* negation - insults and threats up to three words behind "not" become *negated*;
* reported speech - behind a reporting verb, to the end of the clause, *reported*;
* target - behind a word that points at someone, or up to three words before one, *directed*.

The composed machine reads a clause (up to ``.!?;:`` or a line end) forwards, a last one backwards, and
turns it into events; the score of a document comes from its matched clauses, not from isolated words: a clause
counts for each kind of event with its strongest word of that kind.

Learned from labelled rows only: which words and word beginnings insult (log odds
of toxic against clean documents, which are their strength), and the weight of each kind of event, by logistic
regression around fixed prior weights. In it directed events never weigh less than undirected ones, and both more than
negated or reported ones, so that kinds which the labels do not show (threats, say) keep their prior. The fit uses at most ``max_rows`` labelled rows, those of smallest
hash; everything else covers all documents. Nothing but the text enters a score.

Scoring is one scan without a shuffle. Null and empty texts match nothing and get
the score of a text without events, below one half. Repeated rows score alike. If
no labelled row or no toxic one exists, the built-in lists score with fixed weights.
Labels that contradict each other count as toxic; null labels are not used.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingspark.llm.common import documents, remainder, text_slices

#: Small word lists in English, German, French and Spanish.
INSULTS = ("idiot moron stupid pathetic worthless scum trash loser disgusting clown "
           "trottel arschloch abschaum versager dummkopf widerlich crétin connard minable ordure imbécile abruti "
           "imbécil estúpido basura asqueroso perdedor payaso").split()
THREATS = "kill hurt destroy shoot stab strangle umbringen töten tuer frapper matar golpear".split()
TARGETS = ("you your youre he she they them him her this these those du ihr sie dich dein "
           "tu toi vous ton il elle ils tú usted ustedes ellos ella").split()
NEGATIONS = "not no never isnt arent dont cannot nicht kein keine nie pas jamais aucun nunca jamás ni".split()
REPORTING = ("said says called calls quoted quote wrote claimed claims according sagte schrieb "
             "dit écrit selon dijo escribió según").split()

#: Symbols: class in the low three bits, marks above.
OTHER, INSULT, THREAT, TARGET, NEGATE, REPORT = range(6)
NEGATED, REPORTED, DIRECTED = 8, 16, 32
END = 64  # a word that closes its clause
#: Events of a kind by rising weight: silenced (negated or reported) or plain, and each undirected, then directed.
RANKS = 4
#: Prior weight of an event beyond the one before it, insults then threats; the intercept without labels.
PRIOR = (0.5, 0.5, 3.0, 3.0, 0.25, 0.25, 2.0, 5.0)
INTERCEPT, LEAST = -3.0, 0.1
MIN_STEM, MAX_STEM = 4, 7
PUNCTUATION = ".,;:!?\"'()[]{}<>#*$%&|-_=+~`/\\“”„«»…"
LEET = str.maketrans("013457@$", "oieastas")


@dataclass(frozen=True)
class Transducer:
    """``arcs[state][symbol]`` = (next state, symbol written); state 0 begins a clause."""

    arcs: tuple[dict[int, tuple[int, int]], ...]

    def compose(self, other: Transducer) -> Transducer:
        """The machine that feeds what this one writes to ``other``."""
        order, arcs = {(0, 0): 0}, []
        for a, b in (queue := [(0, 0)]):
            step = {}
            for symbol, (a_next, middle) in self.arcs[a].items():
                b_next, out = other.arcs[b][middle]
                if (a_next, b_next) not in order:
                    order[a_next, b_next] = len(order)
                    queue.append((a_next, b_next))
                step[symbol] = (order[a_next, b_next], out)
            arcs.append(step)
        return Transducer(tuple(arcs))


def _marker(trigger: int, mark: int, memory: int | None) -> Transducer:
    """Marks insults and threats behind ``trigger``, for ``memory`` words or to the clause's end."""
    last = memory or 1
    arcs = []
    for state in range(last + 1):
        step = {}
        for symbol in range(64):
            kind = symbol & 7
            if kind == trigger:
                step[symbol] = (last, symbol)
            else:
                later = state if memory is None else max(0, state - 1)
                step[symbol] = (later, symbol | mark if state and kind in (INSULT, THREAT) else symbol)
        arcs.append(step)
    return Transducer(tuple(arcs))


#: Read forwards, then (targets that follow) backwards.
GRAMMAR = _marker(NEGATE, NEGATED, 3).compose(_marker(REPORT, REPORTED, None)).compose(_marker(TARGET, DIRECTED, None))
BACKWARD = _marker(TARGET, DIRECTED, 3)


def stems(word: str) -> Iterator[str]:
    """What the lexicon may know a word by: itself (with a final ``$``) and its beginnings."""
    yield word + "$"
    for n in range(MIN_STEM, min(MAX_STEM, len(word)) + 1):
        yield word[:n]


class Lexicon(dict):
    """Word as written → (class, with END where it closes a clause); fills itself."""

    def __init__(self, weights: dict[str, float], limit: int = 100_000):
        self.weights, self.limit = weights, limit
        self.strength: dict[str, float] = {}
        self.classes = {w: c for c, words in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATE, NEGATIONS), (REPORT, REPORTING)) for w in words}

    def __missing__(self, word: str) -> int:
        if len(self) > self.limit:
            self.clear()
        bare = word.strip(PUNCTUATION).translate(LEET).replace("'", "").replace("’", "")
        weight = max((self.weights.get(s, 0.0) for s in stems(bare)), default=0.0) if bare else 0.0
        code = INSULT if weight > 0 else self.classes.get(bare, OTHER)
        if weight > 0:
            self.strength[word] = weight
        tail = word.rstrip("\"')]}”»#*$%&|")
        self[word] = code = code | (END if tail[-1:] in tuple(".!?;:") else 0)
        return code


def clause_events(codes: list[int], strengths: list[float]) -> dict[int, float]:
    """Events of a clause, given the classes of its words: place of the kind of event → its greatest strength."""
    state, symbols = 0, []
    for code in codes:
        state, symbol = GRAMMAR.arcs[state][code & 7]
        symbols.append(symbol)
    state, found = 0, {}
    for symbol, strength in zip(reversed(symbols), reversed(strengths)):
        state, symbol = BACKWARD.arcs[state][symbol]
        if symbol & 7 in (INSULT, THREAT):
            place = RANKS * (symbol & 7 == THREAT) + 2 * (not symbol & (NEGATED | REPORTED)) + bool(symbol & DIRECTED)
            found[place] = max(found.get(place, 0.0), strength)
    return found


def events_of(text: str | None, lexicon: Lexicon) -> np.ndarray:
    """Strength of the clauses by kind of event, added up (log scale)."""
    out = np.zeros(2 * RANKS)
    words = (text or "").lower().replace("\n", " . ").split()
    codes = [lexicon[w] for w in words]
    if not {INSULT, THREAT, INSULT | END, THREAT | END}.intersection(codes):
        return out
    stops = [i + 1 for i, code in enumerate(codes) if code & END] + [len(codes)]
    done = 0
    for at, code in enumerate(codes):
        if code & 7 in (INSULT, THREAT) and at >= done:
            place = bisect_right(stops, at)
            begin, done = stops[place - 1] if place else 0, stops[place]
            strengths = [lexicon.strength.get(w, 1.0) for w in words[begin:done]]
            for event, strength in clause_events(codes[begin:done], strengths).items():
                out[event] += strength
    return np.log1p(out)


def _stem_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in text_slices(batches, limit=4_000_000):
        counts = (Counter(), Counter())
        for text, toxic in zip(piece.column("text").to_pylist(), piece.column("toxic").to_pylist()):
            words = {w.strip(PUNCTUATION) for w in (text or "").lower().split()}
            counts[1 if toxic else 0].update({s for w in words if w.isalpha() for s in stems(w)})
        keys = list(counts[1] | counts[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in counts[::-1])],
            names=["stem", "n_toxic", "n_clean"])


def _features(weights: dict[str, float]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(weights)
        for piece in text_slices(batches, limit=8_000_000):
            rows = [events_of(t, lexicon).tolist() for t in piece.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column("toxic"), pa.array(rows, pa.list_(pa.float64()))], names=["toxic", "x"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 500) -> np.ndarray:
    """Intercept and event weights: ridge logistic regression around ``PRIOR``, by Newton steps for one weight at a time.

    The unknowns are what each event weighs beyond the one before it in its kind, ``LEAST`` at least: that orders the weights.
    """
    beyond = np.concatenate([np.cumsum(part[:, ::-1], axis=1)[:, ::-1] for part in np.split(x, 2, axis=1)], axis=1)
    columns = [np.ones(len(x)), *np.ascontiguousarray(beyond.T)]
    prior, penalty = np.array([INTERCEPT, *PRIOR]), np.array([1e-3] + [ridge] * len(PRIOR))
    w = prior.copy()
    z = sum(c * v for c, v in zip(columns, w))
    for _ in range(rounds):
        moved = 0.0
        for i, column in enumerate(columns):
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            slope = column @ (y - p) - penalty[i] * (w[i] - prior[i])
            step = np.clip(slope / ((column * column) @ (p * (1 - p)) + penalty[i]), -1.0, 1.0)
            step = step if i == 0 else max(step, LEAST - w[i])
            w[i] += step
            z += step * column
            moved = max(moved, abs(step))
        if moved < 1e-6:
            break
    return np.concatenate([w[:1], *(np.cumsum(part) for part in np.split(w[1:], 2))])


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[str, float]
    coefficients: tuple[float, ...]


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 40_000, max_stems: int = 256) -> ToxicityModel:
    """Learn stems and event weights from at most ``max_rows`` labelled rows, half toxic if there are so many.

    ``docs`` has doc_id and text, ``labels`` doc_id and toxic. The sample is sent
    to the tasks as a table of ids; of it the driver gets stem counts and a few
    numbers per row.
    """
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    picked = known.filter("toxic = 1").orderBy(*order).limit(max_rows // 2).unionByName(
        known.filter("toxic = 0").orderBy(*order).limit(max_rows // 2))
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "toxic").persist()
    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = totals.get(1, 0), totals.get(0, 0)
    weights = {w + "$": 1.0 for w in INSULTS}
    if not n_toxic or not n_clean:
        sample.unpersist()
        return ToxicityModel(weights, (INTERCEPT, *(float(w) for part in np.split(np.array(PRIOR), 2) for w in np.cumsum(part))))
    # So many toxic documents and no clean one would be chance with probability exp(-40).
    support = max(5, 40 / math.log((n_toxic + n_clean) / n_toxic))
    odds = F.log((F.col("a") + 0.5) / F.lit(n_toxic + 1.0)) - F.log((F.col("b") + 0.5) / F.lit(n_clean + 1.0))
    found = sample.mapInArrow(_stem_counts, "stem string, n_toxic long, n_clean long") \
        .groupBy("stem").agg(F.sum("n_toxic").alias("a"), F.sum("n_clean").alias("b")) \
        .filter(F.col("a") >= support).withColumn("odds", odds) \
        .filter(F.col("odds") > math.log(30)) \
        .orderBy((F.col("a") * F.col("odds")).desc(), "stem").limit(max_stems).collect()
    # Strength 1 is the least log odds that count; words of the lists have it unless they are learned.
    weights |= {r["stem"]: r["odds"] / math.log(30) for r in found}
    rows = sample.mapInArrow(_features(weights), "toxic int, x array<double>").collect()
    sample.unpersist()
    w = _logistic(np.array([r["x"] for r in rows]), np.array([r["toxic"] for r in rows], float))
    return ToxicityModel(weights, tuple(map(float, w)))


def _score(model: ToxicityModel):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, w = Lexicon(model.weights), np.array(model.coefficients)
        for piece in text_slices(batches, limit=8_000_000):
            x = np.array([events_of(t, lexicon) for t in piece.column("text").to_pylist()])
            score = 1 / (1 + np.exp(-np.clip(x @ w[1:] + w[0], -30, 30)))
            names = [c for c in piece.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in names), pa.array(score)], names=[*names, "score"])

    return run


def score_texts(docs: DataFrame, model: ToxicityModel, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``carry`` of every row and its ``score``."""
    chosen = docs.select(*(F.col(c) for c in carry), F.col(text).alias("text"))
    fields = ", ".join(f"`{c}` {chosen.schema[c].dataType.simpleString()}" for c in carry)
    return chosen.mapInArrow(_score(model), f"{fields}, score double")


def drop_toxic(docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all their columns unchanged."""
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text")).select("row", "text")
    rows = whole.select("row", "text")
    scored = rows.select(F.col("row"), F.col("text")).mapInArrow(
        _score(model), f"row {rows.schema['row'].dataType.simpleString()}, score double")
    return scored.filter(F.col("score") < threshold).select("row.*")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = fit(docs, labels.filter(remainder(F.col("doc_id"), 5) != 0))
    return score_texts(docs, model).select(
        "doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
