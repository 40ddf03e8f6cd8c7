"""SimHash near-dedup with covering locality-sensitive hashing.

Each of the 64 fingerprint bits gets a vector of radius + 1 bits; every non-zero vector v names one table, whose
mask keeps the bits with odd inner product. `radius` differing bits span at most so many dimensions, so some v is
orthogonal to all of them: every pair within the radius agrees on that mask and collides in its table. Only
distinct fingerprints enter the tables, and only those that share a bucket with another go on.

Candidates are then settled exactly without forming pairs: two fingerprints are within r bits of each other just
when some point is within r // 2 bits of one and (r + 1) // 2 of the other. Each candidate names its points, 65 for
radius 2 and 2081 for radius 4; as many fingerprints at most name one point, and all that name it are linked to the
smallest of those that are nearer. Random fingerprints rarely share a bucket of some 35 bits, so few are candidates.
Alternating large-star and small-star steps turn the links into components. No step gathers a bucket, and keys that
hold many rows are broadcast or combined first.

Defined cases: a null text counts as empty; a text without words has fingerprint zero and is linked like any
other; a text of any length is hashed whole; repeated rows share fingerprint and component; the component is named by
its smallest doc_id (null only if all are null); near_dedup decides by row and leaves one of the rows that carry that
id, the one with the least key; an empty table gives an empty result; only id and text are read, so other columns can't
clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, join_unique, keep_rows, row_key

RADIUS, SHINGLE, SEED, BITS = 2, 3, 42, 64


def masks(radius: int = RADIUS) -> list[int]:
    """One mask per non-zero vector of radius + 1 bits; bit i has the vector 1 + i mod (2 ** (radius + 1) - 1)."""
    top = 1 << (radius + 1)
    vector = [1 + i % (top - 1) for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (vector[i] & v).bit_count() % 2) for v in range(1, top)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint(text: bytes) -> int:
    """SimHash of the SHINGLE-word shingles of a text in UTF-8; a bit is set if it is set in over half the hashes."""
    words = text.lower().split()  # of bytes: A-Z only, and exactly the six ASCII white space characters
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = [b"%b %b %b" % w for w in zip(words, words[1:], words[2:])]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, SEED) for s in shingles], "<u8")
    total = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 65_536):
        part = h[i : i + 65_536]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        got = [signed(fingerprint(t.as_py() or b"")) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(got, pa.int64())], ["doc_id", *batch.schema.names[2:], "fp"])


def candidates(prints: DataFrame, scratch: Scratch, radius: int = RADIUS) -> DataFrame:
    """Of distinct fingerprints (fp), those that share a bucket of some table with another."""
    table = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.lit(signed(m)).alias("m")) for i, m in enumerate(masks(radius))]))
    rows = prints.select("fp", table.alias("x")).select("fp", F.struct(F.col("x.t").alias("t"), F.col("fp").bitwiseAND(F.col("x.m")).alias("k")).alias("bucket"))
    rows = scratch.save(rows, "buckets")
    shared = scratch.save(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "shared")
    return join_unique(rows, shared, "bucket", rows.count(), "n").select("fp").distinct()


def _flips(bits: int) -> list[int]:
    """All words of at most so many set bits."""
    return [signed(sum(1 << i for i in at)) for n in range(bits + 1) for at in combinations(range(BITS), n)]


def links(found: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v), v < u: links within the radius that connect what pairs within it connect."""
    near, far = radius // 2, (radius + 1) // 2
    flips = F.explode(F.split(F.lit(",".join(map(str, _flips(far)))), ",").cast("array<long>")).alias("bits")  # folds to one literal
    points = found.select("fp", flips).select("fp", F.col("fp").bitwiseXOR(F.col("bits")).alias("point"), (F.bit_count("bits") <= near).alias("near"))
    # as many fingerprints at most name a point as there are words of so few bits: these groups are bounded
    same = Window.partitionBy("point")
    hub = F.min(F.when(F.col("near"), F.col("fp"))).over(same)
    both = points.select(F.col("fp").alias("u"), hub.alias("v")).filter("u != v")
    return both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of edges (u, v): root is the smallest node of its component."""
    edges = scratch.save(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    last = None
    while True:
        # large star: hang every larger neighbour of a node on the node's smallest neighbour
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        higher = F.sum((F.col("v") > F.col("u")).cast("long")).alias("n")
        low = scratch.save(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), higher).filter("n > 0"), "low")
        # a root has all its component's nodes as neighbours, so this join must stand hot keys
        hung = join_unique(both.filter("v > u"), low, "u", edges.count(), "n")
        large = scratch.save(hung.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        # small star: hang every smaller neighbour, and the node, on the smallest
        low = scratch.save(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "low")
        moved = join_unique(large, low, "u", large.count(), "n").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = scratch.save(moved.unionByName(low.select("u", F.col("m").alias("v"))).filter("u > v").distinct(), "small")
        state = small.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(edges, large)
        edges = small
        if state == last:
            roots = edges.select(F.col("v").alias("node")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                roots.select("node", F.col("node").alias("root"))
            )
        last = state


def _members(docs: DataFrame, id_col: str, text_col: str, radius: int, key: Column | None = None) -> DataFrame:
    """near_groups with the component's root, and the key of the row if one is given."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = scratch.save(
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *([] if key is None else [key.alias("key")])).mapInArrow(
            _fingerprints, f"doc_id {kind}, {'' if key is None else 'key string, '}fp long"
        ),
        "prints",
    )
    prints = scratch.save(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    found = scratch.save(candidates(prints.select("fp"), scratch, radius), "candidates")
    member = scratch.save(components(links(found, radius), scratch), "members")
    rooted = scratch.save(
        prints.join(member, F.col("fp") == F.col("node"), "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root")), "rooted"
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("prints"))
    n_prints = rooted.count()
    by_print = scratch.save(join_unique(rooted, scratch.save(named, "named"), "root", n_prints, "prints").select("fp", "n", "root", "component_id"), "by_print")
    return join_unique(rows, by_print, "fp", rows.count(), "n")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fp (long), component_id."""
    return _members(docs, id_col, text_col, radius).select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row of docs for every component, one that carries its smallest doc_id, all columns unchanged."""
    key = row_key(id_col, text_col)
    scratch = Scratch(docs.sparkSession, "simhash-rows")
    named = F.col("doc_id").eqNullSafe(F.col("component_id"))
    rows = scratch.save(_members(docs, id_col, text_col, radius, key).select("root", "key", named.alias("named")), "rows")
    winners = rows.filter("named").groupBy("root").agg(F.min("key").alias("key")).select("key", F.lit(True).alias("won"))
    counted = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    verdicts = scratch.save(counted.join(winners, "key", "left").select("key", "n", F.coalesce("won", F.lit(False)).alias("kept")), "verdicts")
    return keep_rows(docs, key, verdicts, once=True)
