"""Secret scan: patterns find candidates, their spread over the corpus tells examples from leaks.

Base patterns of three kinds (``assign``, ``access``, ``hex``) give spans. All
candidate values - those of the base patterns and opaque tokens of mixed
character classes - are hashed, and the corpus is asked in how many distinct
repositories and by how many distinct owners each hash occurs. A value that
many owners hold is a copied example. A value of few owners and few
repositories that also looks random (enough distinct characters, letters and
digits) is ``live``: its span is added under that kind.

Spans are in code points, end exclusive. They come from matched strings: no
pattern looks around itself, so the leftmost match after a position starts where
its own text first occurs after that position.

Plan: one scan keeps a small row per document, written once. Candidates are
counted with partial sums over (hash, owner) and (hash, repository), so a value
that a third of all rows hold is never gathered. Only live hashes are joined
back. Null and empty texts have no span; a null owner or repository counts as
one unnamed owner. Repeated rows are reported separately, but are the same
repository. Only SQL expressions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingspark.llm.common import documents, let, store

#: The base patterns in the order in which kinds are listed.
ASSIGN = (r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?"
          r"([A-Za-z0-9+/_.=-]+)")
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Tokens of a candidate character run, 20 characters or more.
OPAQUE = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "live")

_SPAN = "struct<start:int,kind:int,stop:int,value:string>"


def _place(text: Column, found: Column, kind: int) -> Column:
    """Spans of the strings ``found``, which follow each other in ``text``."""
    empty = F.struct(F.lit(1).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("spans"))

    def step(acc: Column, match: Column) -> Column:
        def place(start: Column) -> Column:
            stop = start + F.length(match)
            span = F.struct((start - 1).cast("int").alias("start"), F.lit(kind).alias("kind"),
                            (stop - 1).cast("int").alias("stop"), match.alias("value"))
            return F.struct(stop.cast("int").alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

        return let(F.call_function("locate", match, text, acc["at"]), place)

    return F.aggregate(found, empty, step, lambda acc: acc["spans"])


def _kept_value(kind: int, match: Column) -> Column:
    """The secret within a match: group 2 of an assignment, else all of it."""
    return F.regexp_extract(match, ASSIGN, 2) if kind == 0 else match


def looks_random(value: Column) -> Column:
    """Letters and digits, and enough distinct characters for a credential."""
    distinct = F.size(F.array_distinct(F.split(value, "")))
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.length(value) >= 16) & (distinct >= 10)


def find_candidates(docs: DataFrame, text: str, repo: str, owner: str) -> DataFrame:
    """One row per document with its spans: rid, base spans, candidate spans; no text."""
    body = F.coalesce(F.col(text), F.lit(""))

    def spans(pattern: str, kind: int) -> Column:
        found = F.regexp_extract_all(body, F.lit(pattern), F.lit(0))
        return F.when(body.rlike(pattern), let(found, lambda f: _place(body, f, kind))).otherwise(
            F.array().cast(f"array<{_SPAN}>"))

    base = F.filter(
        F.concat(spans(ASSIGN, 0), spans(ACCESS, 1), spans(HEX, 2)),
        lambda s: (s["kind"] != 0) | (F.length(_kept_value(0, s["value"])) >= 6),
    )
    return docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(repo).alias("repo"), F.col(owner).alias("owner"),
        base.alias("base"), spans(OPAQUE, 3).alias("opaque"),
    )


def _candidates(found: DataFrame) -> DataFrame:
    """(rid, repo, owner, start, stop, value) of every value that may be a credential."""
    def secret(s: Column) -> Column:
        value = F.when(s["kind"] == 0, _kept_value(0, s["value"])).otherwise(s["value"])
        return F.struct((s["stop"] - F.length(value)).cast("int").alias("start"), s["stop"].alias("stop"), value.alias("value"))

    each = found.select(
        "rid", "repo", "owner",
        F.explode(F.array_distinct(F.transform(F.concat("base", "opaque"), secret))).alias("c"),
    ).select("rid", "repo", "owner", "c.*")
    return each.filter(looks_random(F.col("value"))).withColumn("hash", F.sha2("value", 256)).drop("value")


def ownership(candidates: DataFrame) -> DataFrame:
    """Distinct repositories and owners of each candidate hash."""
    def spread(column: str, out: str) -> DataFrame:
        return candidates.groupBy("hash", column).agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("one").alias(out))

    return spread("repo", "n_repos").join(spread("owner", "n_owners"), "hash")


def scan_secrets(docs: DataFrame, text: str = "text", repo: str = "doc_id", owner: str = "source",
                 max_owners: int = 2, max_repos: int = 5) -> DataFrame:
    """Base spans and live spans of every document, and how its candidates spread.

    Returns the ``repo`` column, ``base`` and ``spans`` (arrays of start, kind,
    stop in the order of start, then kind), ``n_live`` and ``n_examples``.
    """
    found = store(find_candidates(docs, text, repo, owner))
    candidates = store(_candidates(found))
    spread = ownership(candidates)
    live = (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)
    judged = candidates.join(spread.filter(live).select("hash"), "hash", "left_semi")
    added = judged.groupBy("rid").agg(F.collect_set(
        F.struct("start", F.lit(3).alias("kind"), "stop")).alias("added"))
    totals = candidates.groupBy("rid").agg(F.count_distinct("hash").alias("n_candidates"))
    plain = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop")))
    return found.join(totals, "rid", "left").join(added, "rid", "left").select(
        F.col("repo").alias(repo), F.array_sort(plain).alias("base"),
        F.array_sort(F.array_union(plain, F.coalesce("added", F.array().cast("array<struct<start:int,kind:int,stop:int>>")))).alias("spans"),
        F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"),
        F.coalesce(F.size("added"), F.lit(0)).alias("n_live"),
    )


def spans_text(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(documents(spark, sf_dir).select("doc_id", "text", "source"))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"),
        "n_candidates", F.when(F.col("n_live") < 0, 0).otherwise(F.col("n_live")).cast("long").alias("n_live"),
    )
