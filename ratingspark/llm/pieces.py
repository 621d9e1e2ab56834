"""SentencePiece encoding and decoding by suffix-array matching, equal to the public library's ids.

A batch of texts is cut into chunks that no piece and no merge can cross (a run
of spaces with what follows it; a line end by itself). Its distinct chunks are
concatenated into one text, which gets a suffix array (suffixes sorted as far as the
longest piece reaches). A binary search finds for each piece of the vocabulary the
range of suffixes that begin with it: these are the edges. They are sorted by
position and relaxed: in each round every chunk takes its best edge - highest
score, then leftmost - that joins two present symbols, until none is left. That
is the order of a BPE vocabulary's merges, for all chunks at a time. Edges whose
ends are gone are dropped, so rounds shrink quickly. A chunk of more than ``LONG`` bytes
(an unbroken token) would need a round for each of its merges; its edges are taken
in the same order from a heap, so that time grows with its length times a logarithm.

Characters without a piece become byte pieces where the vocabulary has them.
Decoding joins the pieces; for any text without U+2581 decoding an encoding gives the text again
(the library writes U+2581 as a space, and so does this).

There is no shuffle: texts go in slices of bounded bytes through one Arrow pass. Null
texts give null ids and a null decoding, empty texts an empty list. Texts of any
length are encoded whole. Only BPE models with identity normalization and a space
before the text are supported; others raise ``ValueError``.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingspark.llm.common import documents, text_slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE_MARK = "▁"
#: Bytes of text that are indexed together.
SLICE = 2_000_000
#: Chunks of more bytes are relaxed by a heap.
LONG = 96
#: Chunks: a line end, spaces with what follows, or spaces alone.
CHUNK = re.compile(r"\n| *[^ \n]+| +")


@dataclass(frozen=True)
class Vocabulary:
    """Pieces as UTF-8 (space instead of U+2581), their scores, byte pieces and the unknown id."""

    pieces: tuple[bytes, ...]
    scores: np.ndarray
    normal: np.ndarray
    byte_ids: tuple[int, ...] | None
    unknown: int


def load_vocabulary(path: str = MODEL) -> Vocabulary:
    """Read the vocabulary (not the encoder) of a model file on the driver."""
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    spec = model.normalizer_spec
    if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or not spec.add_dummy_prefix or spec.remove_extra_whitespaces:
        raise ValueError("only BPE models with identity normalization and a dummy prefix are supported")
    processor = SentencePieceProcessor(model_file=path)
    ids = range(processor.get_piece_size())
    texts = [processor.id_to_piece(i) for i in ids]
    normal = np.array([not (processor.is_byte(i) or processor.is_control(i) or processor.is_unknown(i) or processor.is_unused(i)) for i in ids])
    if any(SPACE_MARK in t.lstrip(SPACE_MARK) or "\n" in t for t, ok in zip(texts, normal) if ok):
        raise ValueError("a piece holds a space behind another character or a line end")
    by_byte = {int(texts[i][3:5], 16): i for i in ids if processor.is_byte(i)}
    return Vocabulary(
        tuple(t.replace(SPACE_MARK, " ").encode() for t in texts), np.array([processor.get_score(i) for i in ids]),
        normal, tuple(by_byte[b] for b in range(256)) if len(by_byte) == 256 else None, processor.unk_id())


def radix_order(columns: np.ndarray) -> np.ndarray:
    """Order of the rows of a table of 16-bit numbers, first column first."""
    *others, last = np.ascontiguousarray(columns.T)
    order = np.argsort(last, kind="stable")
    for column in reversed(others):
        order = order[np.argsort(column[order], kind="stable")]
    return order


def relax_long(start: np.ndarray, end: np.ndarray, piece: np.ndarray, score: np.ndarray,
               present: np.ndarray, label: np.ndarray) -> None:
    """Join the symbols of one chunk by its edges (sorted by position), best score first, then leftmost.

    ``present`` and ``label`` hold the chunk's characters and are changed in place. An edge enters the heap
    when its two symbols stand side by side; one whose symbols have gone since is passed over.
    """
    n = len(present)
    symbols = np.flatnonzero(present)
    after = np.full(n + 1, -1, np.int64)
    before = np.full(n + 1, -1, np.int64)
    after[symbols] = np.append(symbols[1:], n)
    before[np.append(symbols[1:], n)] = symbols
    # Equal scores get equal ranks; the edge's number decides between them, hence its position.
    rank = np.unique(-score, return_inverse=True)[1].astype(np.int64) << 32 | np.arange(len(start))
    ready = (after[start] < end) & (after[np.maximum(after[start], 0)] == end) if len(start) else np.zeros(0, bool)
    heap = rank[ready].tolist()
    heapify(heap)
    opens = memoryview(np.searchsorted(start, np.arange(n + 1)).astype(np.int64))
    begins, ends, ranks = (memoryview(np.ascontiguousarray(x, np.int64)) for x in (start, end, rank))
    after, before = memoryview(after), memoryview(before)
    taken = memoryview(np.full(n, -1, np.int64))
    while heap:
        edge = heappop(heap) & 0xFFFFFFFF
        left, stop = begins[edge], ends[edge]
        right = after[left]
        if right < 0 or right >= stop or after[right] != stop:
            continue
        after[left], before[stop] = stop, left
        after[right] = -1
        taken[left], taken[right] = edge, -2
        if (previous := before[left]) >= 0:
            for e in range(opens[previous], opens[previous + 1]):
                if ends[e] == stop:
                    heappush(heap, ranks[e])
        if stop < n:
            beyond = after[stop]
            for e in range(opens[left], opens[left + 1]):
                if ends[e] == beyond:
                    heappush(heap, ranks[e])
    chosen = np.asarray(taken)
    present[chosen == -2] = False
    whole = np.flatnonzero(chosen >= 0)
    label[whole] = piece[chosen[whole]]


class Matcher:
    """Finds the edges of a text: which pieces stand where."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        ids = np.flatnonzero(vocabulary.normal)
        lengths = np.array([len(vocabulary.pieces[i]) for i in ids])
        self.width = -(-int(lengths.max()) // 2) * 2
        self.ids, self.lengths = ids.astype(np.int32), lengths.astype(np.int32)
        self.single = np.array([len(vocabulary.pieces[i].decode()) == 1 for i in ids])
        self.low = np.array([vocabulary.pieces[i] for i in ids], f"S{self.width}")
        self.high = np.array([vocabulary.pieces[i].ljust(self.width, b"\xff") for i in ids], f"S{self.width}")

    def suffix_array(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions by suffix, and the suffixes themselves, as far as the longest piece."""
        padded = np.concatenate([text, np.zeros(self.width, np.uint8)])
        heads = np.lib.stride_tricks.sliding_window_view(padded, self.width)[:len(text)].copy()
        order = radix_order(heads.view(">u2").reshape(len(text), -1).astype(np.uint16))
        return order, heads.view(f"S{self.width}").ravel()[order]

    def edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and piece of every longer occurrence, by position; the piece of each single character."""
        order, suffixes = self.suffix_array(text)
        begin = np.searchsorted(suffixes, self.low, "left")
        n = np.searchsorted(suffixes, self.high, "right") - begin
        del suffixes
        order = order.astype(np.int32)

        def spread(which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            times = n[which]
            flat = np.arange(times.sum(), dtype=np.int32)
            flat += np.repeat((begin[which] - np.cumsum(times) + times).astype(np.int32), times)
            start = order[flat]
            return start, start + np.repeat(self.lengths[which], times), np.repeat(self.ids[which], times)

        start, _, piece = spread(self.single)
        label = np.full(len(text), -1, np.int32)
        label[start] = piece
        start, end, piece = spread(~self.single)
        by_position = radix_order(np.column_stack([start >> 16, start & 0xFFFF]).astype(np.uint16))
        return start[by_position], end[by_position], piece[by_position], label

    def encode_chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks one behind the other, and how many each chunk has."""
        sizes = np.array([len(c) for c in chunks])
        text = np.frombuffer(b"\x00".join(chunks) + b"\x00", np.uint8)
        first = np.cumsum(sizes + 1) - sizes - 1
        owner = np.repeat(np.arange(len(chunks), dtype=np.int32), sizes + 1)
        # No piece holds the separator, so no edge leaves its chunk. A symbol begins at each character; separators stand alone.
        present = (text & 0xC0) != 0x80
        start, end, piece, label = self.edges(text)
        score = self.vocabulary.scores[piece].astype(np.float32)
        chunk = owner[start]
        if (long := np.flatnonzero(sizes > LONG)).size:
            bounds = np.searchsorted(start, np.column_stack([first[long], first[long] + sizes[long]]))
            for (low, high), at, size in zip(bounds, first[long], sizes[long]):
                relax_long(start[low:high] - at, end[low:high] - at, piece[low:high], score[low:high],
                           present[at:at + size], label[at:at + size])
            others = (sizes <= LONG)[chunk]
            start, end, piece, score, chunk = (x[others] for x in (start, end, piece, score, chunk))
        while len(start):
            count = np.concatenate([np.zeros(1, np.int32), np.cumsum(present, dtype=np.int32)])
            symbols = count[end] - count[start]
            alive = present[start] & present[end] & (symbols > 1)
            start, end, piece, score, chunk, symbols = (x[alive] for x in (start, end, piece, score, chunk, symbols))
            ready = np.flatnonzero(symbols == 2)
            if not len(ready):
                break
            # Edges are sorted by position, so those of a chunk lie together; the first best is the leftmost.
            groups = np.concatenate([[0], np.flatnonzero(np.diff(chunk[ready])) + 1])
            best = np.maximum.reduceat(score[ready], groups)
            top = np.flatnonzero(score[ready] == np.repeat(best, np.diff(np.append(groups, len(ready)))))
            taken = ready[top[np.concatenate([[True], np.diff(chunk[ready][top]) != 0])]]
            where, until = start[taken], end[taken]
            span = until - where
            gone = np.repeat(where + 1, span - 1) + np.arange((span - 1).sum()) - np.repeat(np.cumsum(span - 1) - span + 1, span - 1)
            present[gone] = False
            label[where] = piece[taken]
        return self._collect(text, present, label, first, sizes, owner)

    def _collect(self, text, present, label, first, sizes, owner) -> tuple[np.ndarray, np.ndarray]:
        separator = np.zeros(len(text), bool)
        separator[first + sizes] = True
        at = np.flatnonzero(present & ~separator)
        ids, chunk = label[at], owner[at]
        if (missing := ids < 0).any():
            # Only single characters have no piece: their bytes stand for them.
            if self.vocabulary.byte_ids is None:
                ids[missing] = self.vocabulary.unknown
            else:
                width = np.ones(len(at), np.int64)
                stops = np.flatnonzero(present)
                length = np.diff(np.append(stops, len(text)))[np.searchsorted(stops, at)]
                width[missing] = length[missing]
                from_bytes = np.repeat(missing, width)
                place = np.repeat(at, width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
                ids, chunk = np.repeat(ids, width), np.repeat(chunk, width)
                ids[from_bytes] = np.array(self.vocabulary.byte_ids)[text[place[from_bytes]]]
        return ids, np.bincount(chunk, minlength=len(sizes))

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Ids of each text; equal chunks of the batch are matched once."""
        index: defaultdict[str, int] = defaultdict()
        index.default_factory = index.__len__
        rows: list[np.ndarray | None] = []
        for text in texts:
            if text is None:
                rows.append(None)
                continue
            # The separator has no piece, so a chunk that holds it is encoded by the parts around it.
            parts = CHUNK.findall(" " + text.replace(SPACE_MARK, " ")) if text else []
            rows.append(np.fromiter(map(index.__getitem__, parts), np.int64, len(parts)))
        if not index:
            return [None if r is None else r for r in rows]
        chunks = [c.encode("utf-8", "surrogatepass") for c in index]
        split = [c.split(b"\x00") for c in chunks]
        if any(len(s) > 1 for s in split):
            flat, counts = self.encode_chunks([p for s in split for p in s])
            bounds = np.append(0, np.cumsum(counts))
            zero = self.vocabulary.byte_ids[0] if self.vocabulary.byte_ids else self.vocabulary.unknown
            lists, part = [], 0
            for s in split:
                own: list[int] = []
                for k in range(len(s)):
                    own += ([zero] if k else []) + flat[bounds[part + k]:bounds[part + k + 1]].tolist()
                part += len(s)
                lists.append(own)
            ids, counts = np.array([i for own in lists for i in own], np.int64), np.array([len(own) for own in lists])
        else:
            ids, counts = self.encode_chunks(chunks)
        begin = np.cumsum(counts) - counts

        def gather(row: np.ndarray) -> np.ndarray:
            n = counts[row]
            return ids[np.repeat(begin[row] - np.cumsum(n) + n, n) + np.arange(n.sum())]

        return [None if r is None else gather(r) for r in rows]


def decode(ids: Iterable[int], vocabulary: Vocabulary) -> str:
    """The text of ``ids``; bytes that are no UTF-8 become replacement characters."""
    return decoder(vocabulary)(ids)


def decoder(vocabulary: Vocabulary):
    pieces = [p if ok else b"" for p, ok in zip(vocabulary.pieces, vocabulary.normal)]
    for byte, i in enumerate(vocabulary.byte_ids or ()):
        pieces[i] = bytes([byte])
    pieces[vocabulary.unknown] = " ⁇ ".encode()

    def run(ids: Iterable[int]) -> str:
        text = b"".join(map(pieces.__getitem__, ids))
        return text[text[:1] == b" ":].decode("utf-8", "replace")

    return run


def _encode(vocabulary: Vocabulary):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(vocabulary)
        for piece in text_slices(batches, limit=SLICE):
            rows = matcher.encode(piece.column("text").to_pylist())
            counts = [0 if r is None else len(r) for r in rows]
            flat = np.concatenate([np.zeros(0, np.int64), *(r for r in rows if r is not None)]).astype(np.int32)
            offsets = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32), pa.int32())
            ids = pa.ListArray.from_arrays(offsets, pa.array(flat))
            if any(r is None for r in rows):
                ids = pa.array([None if r is None else r.astype(np.int32) for r in rows], pa.list_(pa.int32()))
            names = [c for c in piece.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in names), piece.column("text"), ids], names=[*names, "text", "ids"])

    return run


def _decode(vocabulary: Vocabulary):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = decoder(vocabulary)
        for batch in batches:
            column = batch.column("ids")
            texts = [None if not x.is_valid else back(x.values.to_numpy().tolist()) for x in column]
            names = list(batch.schema.names)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, "decoded"])

    return run


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def encode_texts(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), model: str = MODEL) -> DataFrame:
    """The columns ``carry``, ``text`` and its ``ids`` (array of int)."""
    chosen = docs.select(*(F.col(c) for c in carry), F.col(text).alias("text"))
    return chosen.mapInArrow(_encode(load_vocabulary(model)), f"{_fields(chosen)}, ids array<int>")


def decode_ids(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """Add ``decoded``, the text of the column ``ids``."""
    return encoded.mapInArrow(_decode(load_vocabulary(model)), f"{_fields(encoded)}, decoded string")


def _encode_and_check(vocabulary: Vocabulary):
    """Rows (doc_id, text) → ids and whether decoding them gives the text, in one pass."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, back = Matcher(vocabulary), decoder(vocabulary)
        for piece in text_slices(batches, limit=SLICE):
            texts = piece.column("text").to_pylist()
            rows = [None if r is None else r.astype(np.int32) for r in matcher.encode(texts)]
            good = [r is None or back(r.tolist()) == t.replace(SPACE_MARK, " ") for r, t in zip(rows, texts)]
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array(rows, pa.list_(pa.int32())), pa.array([0 if r is None else len(r) for r in rows], pa.int64()),
                 pa.array([len(t or "") for t in texts], pa.int64()), pa.array(good, pa.bool_())],
                names=["doc_id", "ids", "n_ids", "n_text_chars", "round_trip"])

    return run


def encode_documents(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id``, ``ids``, ``n_ids``, ``n_text_chars`` and whether decoding gives the text again."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _encode_and_check(load_vocabulary(model)),
        "doc_id long, ids array<int>, n_ids long, n_text_chars long, round_trip boolean")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir).select("doc_id", "text"))
