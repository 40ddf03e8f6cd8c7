"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is of order 4 over UTF-16 code units, so an n-gram is one 64-bit integer and counts are exact. Texts are
gathered once into blocks of bounded size, each with the compressed texts and its distinct n-grams, written as a
table bucketed by block; later steps meet a block where it lies. Trusted blocks give n-gram counts, of which every
lower order and the discounts follow. The distinct n-grams of all blocks and their distinct endings are joined with the
sharded counts, order by order from the shortest, and the probabilities return to the blocks that asked. A join key is
an n-gram's ending or context, which at most UNITS distinct n-grams share, so no key is hot; what one or two units
decide is at most UNITS rows and is broadcast. Nothing that grows with the corpus is broadcast or collected; what is
gathered grows with it.

A document's score is its mean negative log probability a code unit. It is kept if that is at most the threshold of
its language and size. Every held-th trusted document, by a hash of its id, is held out of the counts, and thresholds
are of these alone, which the model has not seen. The mean of n units scatters as 1 / sqrt(n), so the QUANTILE is taken
of the held-out documents' distances from their language's median, times sqrt(n); the threshold is the median plus that
quantile / sqrt(n). A language with fewer than LEAST held-out documents takes the quantile of all languages' distances,
each from its own language's median.

Defined cases: a null or empty text has no score and is rejected; a document without a language, or with one that
has no trusted text, takes the threshold over all languages; where the hash holds out nothing, the trusted text
itself gives the thresholds, and where it holds out everything, all documents have the same score and are kept; without
trusted text everything else is kept; a text of any length is counted and scored whole, and one beyond BLOCK is a block
of its own;
repeated rows score alike; the filter decides by row, so rows that share an id, null included, do not share a fate; labels
repeated for an id count once (any trusted one); an empty table gives an empty result. Only id, text, lang and the label
are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, keep_rows, row_key, text_bytes

ORDER, START = 4, 2  # the unit that stands before a text's first
UNITS = 1 << 16
#: Quantile of held-out distances, every how many-th trusted document is held out, held-out documents a language needs.
QUANTILE, HELD, LEAST = 0.995, 5, 50
#: Code units of text in a block, and of the runs that are worked on at once.
BLOCK, RUN = 16_000_000, 1_000_000
ACCURACY = 10_000
#: Rounding that a comparison forgives.
TINY = 1e-9


def units(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2")


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each code unit of the texts, end to end, and the texts' sizes."""
    pad = np.full(ORDER - 1, START, np.uint16)
    coded = [units(t) for t in texts]
    flat = np.concatenate([x for c in coded for x in (pad, c)]) if coded else pad[:0]
    sizes = np.array([len(c) for c in coded], np.int64)
    n = max(len(flat) - ORDER + 1, 0)
    key = np.zeros(n, np.uint64)
    for i in range(ORDER):
        key = (key << np.uint64(16)) | flat[i : i + n].astype(np.uint64)
    begin = np.cumsum(sizes) - sizes + np.arange(len(sizes)) * (ORDER - 1)
    at = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    return key[at], sizes


def runs(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= RUN:
            yield at, texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield at, texts[at:]


def seal(texts: list[str]) -> bytes:
    raw = [t.encode() for t in texts]
    sizes = np.array([len(b) for b in raw], "<i8")
    return zstandard.ZstdCompressor(level=6).compress(np.int64(len(raw)).tobytes() + sizes.tobytes() + b"".join(raw))


def unseal(sealed: bytes) -> list[str]:
    raw = zstandard.ZstdDecompressor().decompress(sealed)
    n = int(np.frombuffer(raw[:8], "<i8")[0])
    stop = 8 + 8 * n + np.cumsum(np.frombuffer(raw[8 : 8 + 8 * n], "<i8"))
    start = np.concatenate([[8 + 8 * n], stop[:-1]]) if n else stop
    return [raw[a:b].decode() for a, b in zip(start.tolist(), stop.tolist())]


def count(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, sorted, and their counts."""
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for _, part in runs(texts):
        k, c = np.unique(grams(part)[0], return_counts=True)
        both = np.concatenate([keys, k])
        keys, back = np.unique(both, return_inverse=True)
        counts = np.bincount(back, np.concatenate([counts, c]), len(keys)).astype(np.int64)
    return keys, counts


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, n = TaskContext.get().partitionId(), 0
    ids, langs, texts, size = [], [], [], 0

    def out(schema: pa.Schema) -> pa.RecordBatch:
        sealed, keys = seal(texts), count(texts)[0].view(np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([(part << 32) + n], pa.int64()),
                pa.array([ids], pa.list_(schema.field(0).type)),
                pa.array([langs], pa.list_(pa.string())),
                pa.array([sealed], pa.binary()),
                pa.array([keys], pa.list_(pa.int64())),
            ],
            ["block", "ids", "langs", "sealed", "keys"],
        )

    schema = None
    for batch in batches:
        schema = batch.schema
        for i, la, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            ids.append(i)
            langs.append(la)
            texts.append(t or "")
            size += len(texts[-1])
            if size >= BLOCK:
                yield out(schema)
                n, ids, langs, texts, size = n + 1, [], [], [], 0
    if ids:
        yield out(schema)


def low(key: Column, n: int) -> Column:
    """The last n units of a key."""
    return key.bitwiseAND(F.lit((1 << 16 * n) - 1))


def context(key: Column) -> Column:
    return F.shiftrightunsigned(key, 16)


def _orders(counts: DataFrame, scratch: Scratch) -> list[tuple[DataFrame, DataFrame, list[float], int]]:
    """From order ORDER down to 1: (key, c), (context: total, n1, n2, n3), discounts, sum of counts.

    The highest order has counts; each lower one counts the distinct units before an n-gram.
    """
    out, grams_ = [], counts
    for order in range(ORDER, 0, -1):
        if order < ORDER:
            grams_ = scratch.save(grams_.groupBy(low(F.col("key"), order).alias("key")).agg(F.count(F.lit(1)).alias("c")), f"order{order}")
        tally = [F.sum(F.when(F.col("c") == i, 1).otherwise(0)) for i in range(1, 5)]
        *n, total = grams_.agg(*tally, F.sum("c")).first()
        n = [x or 0 for x in n]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0.0
        discounts = [max(i + 1 - (i + 2) * y * n[i + 1] / n[i], 0.0) if n[i] else float(i + 1) * 0.5 for i in range(3)]
        by = grams_.groupBy(context(F.col("key")).alias("h")).agg(
            F.sum("c").alias("total"), *[F.sum(F.when(F.least("c", F.lit(3)) == i, 1).otherwise(0)).alias(f"n{i}") for i in (1, 2, 3)]
        )
        out.append((grams_, by, discounts, total or 0))
    return out


def probabilities(wanted: DataFrame, counts: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, logp) for distinct n-grams (key) under the model of counts (key, c)."""
    wants = [wanted.select("key")]
    for order in range(ORDER - 1, 0, -1):
        wants.append(scratch.save(wants[-1].select(low(F.col("key"), order).alias("key")).distinct(), f"wanted{order}"))
    p = None
    for order, own, (grams_, by, d, total) in reversed(list(zip(range(ORDER, 0, -1), wants, _orders(counts, scratch)))):
        # up to order 2 these tables have at most UNITS rows; beyond, a key is shared by at most UNITS rows
        small = F.broadcast if order <= 2 else (lambda x: x.hint("merge"))
        got = own.select("key", context(F.col("key")).alias("h"), low(F.col("key"), max(order - 1, 1)).alias("end"))
        got = got.withColumn("p", F.lit(1.0 / UNITS)) if p is None else got.join(small(p.withColumnRenamed("key", "end")), "end")
        if total:
            many = F.broadcast if order == 1 else (lambda x: x.hint("merge"))
            got = got.join(many(grams_), "key", "left").join(small(by), "h", "left")
            c = F.coalesce("c", F.lit(0))
            cut = F.when(c == 0, 0.0).when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])
            spare = (d[0] * F.col("n1") + d[1] * F.col("n2") + d[2] * F.col("n3")) / F.col("total")
            got = got.withColumn("p", F.coalesce((c - cut) / F.col("total") + spare * F.col("p"), F.col("p")))
        p = scratch.save(got.select("key", "p"), f"p{order}")
    return p.select("key", F.log("p").alias("logp"))


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality", held: int = HELD) -> DataFrame:
    """doc_id, lang, n_units, nll (mean, null for an empty text), trusted, held (out of the counts; held = 0 holds out none)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "kneser-ney")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    blocks = scratch.bucketed(
        rows.mapInArrow(_blocks, f"block long, ids array<{kind}>, langs array<string>, sealed binary, keys array<long>"), "block", text_bytes(docs, text_col)
    )
    good = labels.filter(F.col(label_col) == 1).select(F.col(id_col).alias("doc_id")).filter("doc_id is not null").distinct()
    out_of_counts = F.pmod(F.xxhash64("doc_id"), F.lit(held)) == 0 if held else F.lit(False)
    trusted = scratch.save(
        blocks.select("block", F.posexplode("ids").alias("at", "doc_id")).join(good.hint("merge"), "doc_id").select("block", "at", out_of_counts.alias("held")),
        "trusted",
    )

    def tally(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if left.num_rows and right.num_rows:
            texts = unseal(left.column("sealed")[0].as_py())
            keys, counts = count([texts[i] for i in right.column("at").to_pylist()])
        return pa.table({"key": keys.view(np.int64), "c": counts})

    sealed = blocks.select("block", "sealed").groupBy("block")
    counts = sealed.cogroup(trusted.filter("not held").groupBy("block")).applyInArrow(tally, "key long, c long")
    counts = scratch.save(counts.groupBy("key").agg(F.sum("c").alias("c")), "counts")
    asked = blocks.select(F.col("block").alias("asker"), F.explode("keys").alias("key"))
    model = Scratch(spark, "kneser-ney-model")
    wanted = scratch.save(asked.select("key").distinct(), "wanted")
    known = scratch.save(probabilities(wanted, counts, model), "known")
    model.clear()
    answers = asked.join(known.hint("merge"), "key")

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, logp = right.column("key").to_numpy().view(np.uint64), right.column("logp").to_numpy()
        order = np.argsort(keys)
        keys, logp = keys[order], logp[order]
        texts = unseal(left.column("sealed")[0].as_py())
        n, total = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        for at, part in runs(texts):
            g, sizes = grams(part)
            got = np.concatenate([[0.0], np.cumsum(logp[np.searchsorted(keys, g)])]) if len(g) else np.zeros(1)
            stop = np.cumsum(sizes)
            n[at : at + len(part)], total[at : at + len(part)] = sizes, got[stop] - got[stop - sizes]
        nll = pa.array(-total / np.maximum(n, 1), mask=n == 0)
        ids, langs = (left.column(c)[0].values for c in ("ids", "langs"))
        block = np.full(len(n), left.column("block")[0].as_py(), np.int64)
        return pa.table([ids, langs, pa.array(n), nll, pa.array(np.arange(len(n), dtype=np.int32)), pa.array(block)], names=["doc_id", "lang", "n_units", "nll", "at", "from"])

    scored = (
        blocks.select("block", "ids", "langs", "sealed")
        .groupBy("block")
        .cogroup(answers.groupBy("asker"))
        .applyInArrow(judge, f"doc_id {kind}, lang string, n_units long, nll double, at int, from long")
    )
    marked = trusted.select(F.col("block").alias("from"), "at", "held").hint("merge")
    out = scratch.save(
        scored.join(marked, ["from", "at"], "left").select(
            "doc_id", "lang", "n_units", "nll", F.col("held").isNotNull().alias("trusted"), F.coalesce("held", F.lit(False)).alias("held")
        ),
        "scores",
    )
    scratch.drop(blocks, trusted, counts, wanted, known)
    return out


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality", held: int = HELD) -> DataFrame:
    """doc_id, lang, n_units, nll, perplexity, threshold (of nll), trusted, held, kept."""
    scored = scores(docs, labels, id_col, text_col, lang_col, label_col, held)
    sure = scored.filter(F.col("trusted") & F.col("nll").isNotNull())
    unseen = sure.filter("held")
    sure = sure if unseen.isEmpty() else unseen
    root = F.sqrt(F.greatest("n_units", F.lit(1)))

    def quantile(value: Column, q: float) -> Column:
        return F.percentile_approx(value, F.lit(q), F.lit(ACCURACY))

    def far(middle: Column) -> Column:
        return (F.col("nll") - middle) * root

    middle = F.lit(sure.agg(quantile(F.col("nll"), 0.5).alias("m")).first()["m"]).cast("double")
    over_all = F.lit(sure.agg(quantile(far(middle), QUANTILE).alias("s")).first()["s"]).cast("double")
    ours = sure.filter("lang is not null")
    by_lang = ours.groupBy("lang").agg(quantile(F.col("nll"), 0.5).alias("middle"))  # one row a language of trusted text
    ours = ours.join(F.broadcast(by_lang), "lang")
    pooled = F.lit(ours.agg(quantile(far(F.col("middle")), QUANTILE).alias("s")).first()["s"]).cast("double")
    own = F.when(F.count(F.lit(1)) >= LEAST, quantile(far(F.col("middle")), QUANTILE)).otherwise(pooled)
    by_lang = ours.groupBy("lang").agg(F.first("middle").alias("middle"), own.alias("scatter"))
    got = scored.join(F.broadcast(by_lang), "lang", "left")
    threshold = F.coalesce(F.col("middle"), middle) + F.when(F.col("middle").isNotNull(), F.col("scatter")).otherwise(over_all) / root
    got = got.withColumn("threshold", threshold)
    kept = F.col("nll").isNotNull() & F.coalesce(F.col("nll") <= F.col("threshold") + TINY, F.lit(True))
    return got.select("doc_id", "lang", "n_units", "nll", F.exp("nll").alias("perplexity"), "threshold", "trusted", "held", kept.alias("kept"))


def quality_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that the classifier keeps, all columns unchanged."""
    key = row_key(id_col, text_col, lang_col)
    scratch = Scratch(docs.sparkSession, "quality-rows")
    good = labels.filter(F.col("quality") == 1).select(F.col(id_col).alias("doc_id")).filter("doc_id is not null").distinct()
    # the classifier works on keys for ids, so that a verdict holds for the rows of one key only
    marks = scratch.save(docs.select(F.col(id_col).alias("doc_id"), key.alias("key")).join(good, "doc_id").select("key").distinct(), "marks")
    keyed = docs.select(key.alias("key"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    got = classify(keyed, marks.withColumn("quality", F.lit(1)), "key")
    verdicts = scratch.save(got.groupBy(F.col("doc_id").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept")), "verdicts")
    return keep_rows(docs, key, verdicts, once=False)
