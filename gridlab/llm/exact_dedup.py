"""Exact dedup by a heavy-hitter split.

Misra-Gries summaries, one per task and merged by digest, name the digests that may be frequent. Their exact
sizes and winners are counted in a second pass over the digests (never over texts), and the frequent ones, of
which there are fewer than 2 * K, are broadcast: their rows are decided on the map side. All other digests take an
ordinary shuffle, in which no group holds more than about 1.5 / K of all rows.

Defined cases: a null text counts as empty; empty texts are equal to one another; among equal texts the largest
doc_id stays, a null doc_id counts as the smallest; rows that repeat both the text and the doc_id are marked
alike, so all rows carrying the winning id are marked kept, but the stage leaves one of them (of texts that differ in
case the one with the least key, of identical ones any); verdicts are by row, so rows that share an id, null included, do
not share a fate; a text of any length is hashed whole; an empty table gives an empty result. Only the id
and text columns are read, so other columns can't clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, keep_rows, row_key

#: Counters of a Misra-Gries summary.
K = 1024
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def misra_gries(batches: Iterator[list[bytes]], k: int = K) -> dict[bytes, int]:
    """At most k digests with counts that fall short of the true ones by less than n / (k + 1)."""
    held: Counter = Counter()
    for batch in batches:
        held.update(batch)
        if len(held) > k:
            cut = sorted(held.values(), reverse=True)[k]
            held = Counter({d: c - cut for d, c in held.items() if c > cut})
    return dict(held)


def _summaries(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = misra_gries((b.column(0).to_pylist() for b in batches), k)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["digest", "seen"]
        )

    return run


def _groups(docs: DataFrame, id_col: str, text_col: str, k: int, *more: Column) -> DataFrame:
    """exact_groups with more columns of docs."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    digests = scratch.save(
        docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(ascii_lower(F.col(text_col)), 256)).alias("digest"), *more),
        "digests",
    )
    n = digests.count()
    maybe = (
        digests.select("digest")
        .mapInArrow(_summaries(k), "digest binary, seen long")
        .groupBy("digest")
        .agg(F.sum("seen").alias("seen"))
        .filter(F.col("seen") > n / (2 * k))  # seen never exceeds the true count: fewer than 2 * k rows
        .select("digest")
    )
    group = [F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    heavy = scratch.save(digests.join(F.broadcast(maybe), "digest").groupBy("digest").agg(*group), "heavy")
    rest = digests.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    decided = digests.join(F.broadcast(heavy), "digest").unionByName(
        rest.join(rest.groupBy("digest").agg(*group), "digest")
    )
    return decided.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, digest (32 bytes of the normalised text).

    k: counters of a summary. Digests of more than a (2 * k)-th of all rows are decided on the map side.
    """
    return _groups(docs, id_col, text_col, k).select("doc_id", "keep_id", "group_size", "kept", "digest")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """One row of docs for every text, all columns unchanged."""
    key = row_key(id_col, text_col)
    scratch = Scratch(docs.sparkSession, "exact-rows")
    rows = scratch.save(_groups(docs, id_col, text_col, k, key.alias("key")).select("digest", "key", "kept"), "rows")
    winners = rows.filter("kept").groupBy("digest").agg(F.min("key").alias("key")).select("key", F.lit(True).alias("won"))
    counted = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    verdicts = scratch.save(counted.join(winners, "key", "left").select("key", "n", F.coalesce("won", F.lit(False)).alias("kept")), "verdicts")
    return keep_rows(docs, key, verdicts, once=True)
