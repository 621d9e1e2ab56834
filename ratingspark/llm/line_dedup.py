"""Line dedup: drop lines that an earlier document holds, by streaming sorted line hashes.

A line's key is the line stripped of ASCII white space and with A-Z lower-cased.
Keys of at least ``min_chars`` code points that two documents or more hold lose
all their lines but those of the smallest document id.

1. One pass over the texts hashes the keys (128 bits). Within a slice of the
   input only the smallest id of a hash can still be its first document; rows of
   other ids are dropped at once, which leaves one entry per slice and hash
   however often a line occurs. These entries are written once.
2. They are range-partitioned by hash and sorted by (hash, document, position).
   Streaming over a partition, the first document of a hash stays and later ones
   become drop verdicts. Repeated entries of the winning document are no drops.
3. Verdicts and early drops of a document are joined to one compressed bitmap of
   the lines it keeps. No text is shuffled up to here; applying the bitmaps joins
   them to the texts.

A row is known by its id and a hash of its text, so repeated rows share a bitmap
and ids may repeat: rows of one id count as one document. A null id sorts after
all others (all null ids are one document). A null or empty text is one empty
line. Only the named columns are read, so further columns may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingspark.llm.common import documents, store, text_slices

MIN_CHARS = 10
_WHITE = b" \t\n\x0b\x0c\r"
#: A null id sorts behind every other.
_LAST = np.iinfo(np.int64).max


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def pack(mask: np.ndarray) -> bytes:
    """A compressed bitmap."""
    return zlib.compress(np.packbits(mask).tobytes(), 1)


def unpack(bitmap: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n).astype(bool)


def _hash_lines(min_chars: int):
    """Per slice: (key of row, first-document entries) and rows dropped early."""
    schema = pa.schema([("hash", pa.binary()), ("doc", pa.int64()), ("row_key", pa.int64()),
                        ("line", pa.int32()), ("early", pa.bool_())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_slices(batches, limit=16_000_000):
            ids = piece.column("doc").to_pylist()
            keys = piece.column("row_key").to_pylist()
            first: dict[bytes, int] = {}
            seen: list[tuple[bytes, int, int, int]] = []
            for text, doc, key in zip(piece.column("text").to_pylist(), ids, keys):
                doc = _LAST if doc is None else doc
                for position, line in enumerate((text or "").encode("utf-8", "surrogatepass").split(b"\n")):
                    line = line.strip(_WHITE)
                    if len(line) < min_chars or len(line) < 4 * min_chars and len(line.decode("utf-8", "replace")) < min_chars:
                        continue
                    digest = xxhash.xxh3_128_digest(line.lower())
                    seen.append((digest, doc, key, position))
                    if doc < first.get(digest, _LAST + 1):
                        first[digest] = doc
            if seen:
                hashes, docs, row_keys, positions = zip(*seen)
                early = [first[h] < d for h, d in zip(hashes, docs)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes, pa.binary()), pa.array(docs, pa.int64()), pa.array(row_keys, pa.int64()),
                     pa.array(positions, pa.int32()), pa.array(early, pa.bool_())], schema=schema)

    return run


def _stream_first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (hash, doc, line): emit those whose hash has an earlier document."""
    current, winner = None, None
    for batch in batches:
        drop = []
        for digest, doc in zip(batch.column("hash").to_pylist(), batch.column("doc").to_pylist()):
            if digest != current:
                current, winner = digest, doc
            drop.append(doc != winner)
        yield batch.filter(pa.array(drop, pa.bool_())).select(["doc", "row_key", "line"])


def _pack_drops(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (doc, row_key, line): one bitmap of dropped lines for each document."""
    schema = pa.schema([("doc", pa.int64()), ("row_key", pa.int64()), ("n_marked", pa.int32()), ("bitmap", pa.binary())])
    out: list[tuple] = []
    current, lines = None, []

    def close():
        mask = np.zeros(max(lines) + 1, bool)
        mask[lines] = True
        out.append((*current, len(mask), pack(mask)))

    def flush() -> pa.RecordBatch:
        done = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        out.clear()
        return done

    for batch in batches:
        for doc, key, line in zip(*(batch.column(c).to_pylist() for c in ("doc", "row_key", "line"))):
            if (doc, key) != current:
                if current is not None:
                    close()
                current, lines = (doc, key), []
            lines.append(line)
        if len(out) >= 10_000:
            yield flush()
    if current is not None:
        close()
    if out:
        yield flush()


def drop_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc``, ``row_key``, ``n_marked``, ``bitmap``: the lines that a document loses.

    Documents that lose nothing have no row; lines behind ``n_marked`` stay.
    """
    spark = docs.sparkSession
    lines = store(docs.select(
        F.col(doc_id).cast("long").alias("doc"), text_key(F.col(text)).alias("row_key"), F.col(text).alias("text"),
    ).mapInArrow(_hash_lines(min_chars), "hash binary, doc long, row_key long, line int, early boolean"))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    late = lines.filter(~F.col("early")).select("hash", "doc", "row_key", "line") \
        .repartitionByRange(width, "hash").sortWithinPartitions("hash", "doc", "line") \
        .mapInArrow(_stream_first, "doc long, row_key long, line int")
    drops = late.unionByName(lines.filter("early").select("doc", "row_key", "line"))
    return drops.repartition(width, "doc", "row_key").sortWithinPartitions("doc", "row_key", "line") \
        .mapInArrow(_pack_drops, "doc long, row_key long, n_marked int, bitmap binary")


def _apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace ``text`` by the lines kept; add the counts of lines."""
    for batch in batches:
        texts, n_lines, n_dropped = [], [], []
        for text, n, bitmap in zip(*(batch.column(c).to_pylist() for c in ("text", "n_marked", "bitmap"))):
            lines = (text or "").split("\n")
            n_lines.append(len(lines))
            n_dropped.append(0)
            if bitmap is not None:
                marked = unpack(bitmap, n)
                n_dropped[-1] = int(marked.sum())
                text = "\n".join(x for i, x in enumerate(lines) if i >= n or not marked[i])
            texts.append(text)
        names = [c for c in batch.schema.names if c not in ("n_marked", "bitmap")]
        arrays = [pa.array(texts, batch.schema.field("text").type) if c == "text" else batch.column(c) for c in names]
        yield pa.RecordBatch.from_arrays(
            [*arrays, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
            names=[*names, "n_lines", "n_dropped"])


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """Columns of ``docs`` packed as ``row``, its ``text`` after dropping, ``n_lines``, ``n_dropped``.

    A null text stays null when no line of it goes, which is always so.
    """
    marks = drop_bitmaps(docs, doc_id, text, min_chars)
    rest = [F.col(c) for c in docs.columns if c != text]
    keyed = docs.select(
        F.struct(*rest).alias("row"), F.col(text).alias("text"),
        F.coalesce(F.col(doc_id).cast("long"), F.lit(int(_LAST))).alias("doc"), text_key(F.col(text)).alias("row_key"))
    joined = keyed.join(marks, ["doc", "row_key"], "left").select("row", "text", "n_marked", "bitmap")
    row = joined.schema["row"].dataType.simpleString()
    return joined.mapInArrow(_apply, f"row {row}, text string, n_lines long, n_dropped long")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return done.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH lines AS (
  SELECT d.doc_id, p.i, string_split(coalesce(d.text, ''), chr(10))[p.i] AS line
  FROM documents d, LATERAL (SELECT unnest(range(1, len(string_split(coalesce(d.text, ''), chr(10))) + 1)) AS i) p
), keyed AS (
  SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), firsts AS (
  SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1
), judged AS (
  SELECT l.doc_id, l.i, l.line, f.first_doc IS NOT NULL AND f.first_doc <> l.doc_id AS dropped
  FROM keyed l LEFT JOIN firsts f ON l.k = f.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
