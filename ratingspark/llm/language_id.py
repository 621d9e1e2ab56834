"""Language ID by cross-parsing entropy with suffix automata.

Labelled text of each language becomes a suffix automaton. A text is parsed
against it: each phrase is the longest match from where the last one ended. The
language that needs the fewest phrases for each character wins (ties: the
smaller name); the score is its share of certainty, 1 / (1 + sum of
exp(-sharpness * (r - r_best) / r_best)) over the other languages' rates r.

Characters are folded to classes: the ``ALPHABET - 2`` most frequent lower-case
letters of the labelled text, one class for other letters and one for everything else. An
automaton then is a table, state and class to next state, with a mark where the
match ends and the next phrase begins at the root. Texts are cut into blocks of
``BLOCK`` characters, each of which begins a phrase, and all blocks of a slice step
through the tables together - a parse of whole texts, of any length, in bounded
memory.

Fitted on a bounded sample: of each language the labelled rows of smallest hash, up to
``sample_chars`` characters (``total_chars`` over all languages); only this text,
not the tables, is sent to tasks. Everything else is one scan without a shuffle.

Null texts and texts without a letter are ``und`` with score 0, as are all texts if
nothing is labelled. Null languages are not learned. Repeated rows come out alike.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingspark.llm.common import documents, remainder, text_slices

ALPHABET = 64
BLOCK = 2048
#: Class 0: no letter; class 1: a letter that the labelled text seldom has.
BLANK, RARE = 0, 1


def _fold(char: str) -> str:
    lower = char.lower()
    return lower if len(lower) == 1 else char


def letter_classes(samples: dict[str, str]) -> np.ndarray:
    """Class of every code point."""
    counts: Counter[str] = Counter()
    for text in samples.values():
        counts.update({_fold(c): n for c, n in Counter(text).items() if c.isalpha()})
    common = {c: i + 2 for i, (c, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:ALPHABET - 2])}
    table = np.zeros(0x110000, np.uint8)
    for point in range(0x110000):
        if (char := chr(point)).isalpha():
            table[point] = common.get(_fold(char), RARE)
    return table


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def suffix_automaton(codes: list[int]) -> np.ndarray:
    """Table of (state * ALPHABET + class) → next state * ALPHABET, plus 1 where a phrase ends.

    A phrase ends where no transition is left; the class then begins the next
    phrase at the root (an unknown class is a phrase by itself).
    """
    arcs: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for code in codes:
        current = len(arcs)
        arcs.append({})
        length.append(length[last] + 1)
        link.append(0)
        state = last
        while state != -1 and code not in arcs[state]:
            arcs[state][code] = current
            state = link[state]
        if state != -1:
            target = arcs[state][code]
            if length[state] + 1 == length[target]:
                link[current] = target
            else:
                clone = len(arcs)
                arcs.append(dict(arcs[target]))
                length.append(length[state] + 1)
                link.append(link[target])
                while state != -1 and arcs[state].get(code) == target:
                    arcs[state][code] = clone
                    state = link[state]
                link[target] = link[current] = clone
        last = current
    # One state more: behind a class that the sample lacks, where a phrase ends in any case.
    lost = len(arcs) * ALPHABET
    root = np.full(ALPHABET, lost, np.int32)
    for code, state in arcs[0].items():
        root[code] = state * ALPHABET
    table = np.tile(root + 1, (len(arcs) + 1, 1))
    for state, out in enumerate(arcs):
        if out:
            table[state, list(out)] = np.fromiter(out.values(), np.int32, len(out)) * ALPHABET
    table[0] = root
    return table.ravel()


def count_phrases(table: np.ndarray, blocks: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Phrases of each row of ``blocks`` (rows by falling length; column t is its t-th class)."""
    state = np.zeros(len(blocks), np.int32)
    phrases = np.ones(len(blocks), np.int32)
    ends = np.searchsorted(-lengths, -np.arange(blocks.shape[1]), "left")  # rows longer than t
    by_step = np.ascontiguousarray(blocks.T)
    for step, n in enumerate(ends.tolist()):
        if not n:
            break
        following = table[state[:n] + by_step[step, :n]]
        ended = following & 1
        phrases[:n] += ended
        state[:n] = following - ended
    return phrases


class Parser:
    """Cross-parses texts against the labelled samples of all languages."""

    def __init__(self, samples: dict[str, str], sharpness: float = 20.0):
        self.languages = sorted(samples)
        self.sharpness = sharpness
        self.classes = letter_classes(samples)
        self.tables = [suffix_automaton(self._squeeze(code_points(samples[x])).tolist()) for x in self.languages]

    def _squeeze(self, points: np.ndarray) -> np.ndarray:
        """Classes with runs of blanks cut to one, so that layout costs no phrases."""
        codes = self.classes[points]
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != BLANK) | (codes[:-1] != BLANK)
        return codes[keep]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        codes = [self._squeeze(code_points(t)) if t else np.zeros(0, np.uint8) for t in texts]
        spoken = np.array([bool(c.any()) for c in codes], bool)
        parts, owners = [], []
        for row, code in enumerate(codes):
            if spoken[row]:
                cut = [code[i:i + BLOCK] for i in range(0, len(code), BLOCK)]
                parts += cut
                owners += [row] * len(cut)
        score, best = np.zeros(len(texts)), np.zeros(len(texts), int)
        if parts and self.languages:
            lengths = np.array([len(p) for p in parts])
            order = np.argsort(-lengths, kind="stable")
            blocks = np.zeros((len(parts), lengths.max()), np.uint8)
            for place, part in enumerate(order):
                blocks[place, :lengths[part]] = parts[part]
            owner = np.array(owners)[order]
            rates = np.array([np.bincount(owner, count_phrases(t, blocks, lengths[order]), len(texts)) for t in self.tables])
            rates /= np.maximum(np.array([len(c) for c in codes]), 1)
            best = rates.argmin(axis=0)
            least = np.maximum(rates.min(axis=0), 1e-12)
            score = np.where(spoken, 1 / np.exp(-self.sharpness * (rates - least) / least).sum(axis=0), 0)
        names = [self.languages[b] if s and self.languages else "und" for b, s in zip(best, spoken)]
        return names, score if self.languages else np.zeros(len(texts))


def sample_texts(docs: DataFrame, sample_chars: int = 40_000, total_chars: int = 400_000, max_rows: int = 400) -> dict[str, str]:
    """Labelled text of each language (columns doc_id, text, lang), bounded by the three parameters.

    First a scan of ids keeps, in each task, the ``max_rows`` rows of smallest hash of every language;
    then the texts of the chosen ids are read.
    """
    def choose(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, list[tuple[int, int]]] = {}
        for batch in batches:
            for lang, doc, rank in zip(*(batch.column(c).to_pylist() for c in ("lang", "doc_id", "rank"))):
                kept.setdefault(lang, []).append((rank, doc))
            kept = {k: sorted(set(v))[:max_rows] for k, v in kept.items()}
        rows = [(lang, doc, rank) for lang, v in kept.items() for rank, doc in v]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64()))], names=["lang", "doc_id", "rank"])

    labelled = docs.filter("lang is not null and text is not null and doc_id is not null") \
        .select(F.col("lang").cast("string"), F.col("doc_id").cast("long"), F.xxhash64("doc_id").alias("rank"))
    few = labelled.mapInArrow(choose, "lang string, doc_id long, rank long")
    merged = few.repartition(1).mapInArrow(choose, "lang string, doc_id long, rank long")
    chosen: dict[str, list[int]] = {}
    for row in sorted(merged.collect(), key=lambda r: (r["lang"], r["rank"], r["doc_id"])):
        chosen.setdefault(row["lang"], []).append(row["doc_id"])
    if not chosen:
        return {}
    limit = min(sample_chars, total_chars // len(chosen))
    # The first rows that fill the sample, by lengths alone; a row longer than the rest is cut to fit.
    ids = [d for v in chosen.values() for d in v]
    sizes: dict[tuple[str, int], int] = {}
    wanted = docs.filter(F.col("doc_id").isin(ids))
    for row in wanted.groupBy("lang", "doc_id").agg(F.max(F.length("text")).alias("n")).collect():
        sizes[row["lang"], row["doc_id"]] = row["n"] or 0
    picked: list[int] = []
    for lang, docs_of in chosen.items():
        held = 0
        for doc in docs_of:
            if held >= limit:
                break
            picked.append(doc)
            held += min(sizes.get((lang, doc), 0), limit - held)
    rows = docs.filter(F.col("doc_id").isin(picked) & F.col("lang").isNotNull()).groupBy("lang", "doc_id") \
        .agg(F.substring(F.max("text"), 1, limit).alias("text")).collect()
    samples: dict[str, str] = {}
    for row in sorted(rows, key=lambda r: (r["lang"], picked.index(r["doc_id"]))):
        held = samples.get(row["lang"], "")
        if len(held) < limit:
            samples[row["lang"]] = (held + "\n" + (row["text"] or ""))[:limit]
    return {k: v for k, v in samples.items() if v.strip()}


def _predict(samples: dict[str, str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(samples)
        for piece in text_slices(batches, limit=8_000_000):
            names, score = parser.predict(piece.column("text").to_pylist())
            carried = [c for c in piece.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(piece.column(c) for c in carried), pa.array(names, pa.string()), pa.array(score)], names=[*carried, "lang_pred", "score"])

    return run


def identify_languages(docs: DataFrame, samples: dict[str, str], text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``carry``, ``lang_pred`` and ``score`` of every row."""
    chosen = docs.select(*(F.col(c) for c in carry), F.col(text).alias("text"))
    fields = ", ".join(f"`{c}` {chosen.schema[c].dataType.simpleString()}" for c in carry)
    return chosen.mapInArrow(_predict(samples), f"{fields}, lang_pred string, score double")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    samples = sample_texts(docs.filter(remainder(F.col("doc_id"), 3) != 1))
    return identify_languages(docs, samples).select(
        "doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
