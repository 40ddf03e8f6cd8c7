"""Substring dedup: remove every word covered by a window of words that occurs anywhere else.

Level-wise doubling. Of each target window (35 words) a level looks at one shorter window inside it, the leftmost of
those with the smallest hash, so equal target windows look at equal ones; target windows that share theirs are one
candidate, a range of starts. The first level's shorter windows have 9 words. Candidates whose window occurs once go;
the others alone are extended to twice the length, 18 words, hashed over the surviving ranges and counted again, and
what is left then decides at the target length. The search stops at the first level that leaves no candidate.

Texts are read once into blocks of bounded size, each a row with its compressed documents, in a table bucketed by block.
Candidates and marks travel to the blocks; texts are never shuffled. Equal documents are first reduced to one, whose
words are all repeated; the others of a group need no windows.

Hashes decide without a comparison of words: 64 bits on the way and 128 bits at the target, where two different windows
are taken for equal with a chance of about pairs / 2 ** 128.

Target windows under a candidate that is very frequent (more than a HOT_SHARE-th of all) meet in salted groups first
and one row a salt afterwards; all others take one shuffle with bounded groups. Digests held by many documents are
broadcast, so no group of copies is shuffled to one task.

Defined cases: a null or empty text has no words; a text with fewer words than a window keeps all; windows never
cross documents; a text of any length is one document of one block and is worked on whole; two rows with the same text,
the same doc_id included, are two occurrences; null ids are values like others; an empty table gives an empty result;
extra columns of any name and type are carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from . import common
from .common import Scratch, join_unique, text_bytes

WINDOW = 35
#: Bytes of text in a block, and of the runs that are worked on at once.
BLOCK, RUN = 4_000_000, 1_000_000
#: Salted groups of a window under a hot candidate.
SALTS = 256
#: Lanes of a window hash: odd multipliers and offsets of the two mixers.
MULTIPLY = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
OFFSET = (np.uint64(0x632BE59BD9B4E019), np.uint64(0x165667B19E3779F9))
CANDIDATE = "seed long, lo int, hi int"


def levels(window: int) -> list[int]:
    """Window lengths from the first level to the target, each at most twice the one before."""
    out = [window]
    while out[0] > 9:
        out.insert(0, (out[0] + 1) // 2)
    return out


def mix(a: np.ndarray, b: np.ndarray, lane: int) -> np.ndarray:
    x = (a * MULTIPLY[lane]) ^ (b + OFFSET[lane])
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Two 64-bit lanes a word."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), "<u8").reshape(-1, 2)


def grams(h: np.ndarray, length: int, lane: int) -> np.ndarray:
    """Hashes of all windows of `length` words, by doubling through the levels."""
    at = 1
    for goal in levels(length):
        while at < goal:
            step = min(at, goal - at)
            h = mix(h[: max(len(h) - step, 0)], h[step:], lane)
            at += step
    return h


def leftmost_min(v: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost minimum in each run of `width` values."""
    at, span = np.arange(len(v)), 1
    while span < width:
        step = min(span, width - span)
        a, b = at[: max(len(at) - step, 0)], at[step:]
        at = np.where(v[b] < v[a], b, a)
        span += step
    return at


def digest_of(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


class Runs:
    """Runs of words laid end to end; target windows that stay inside a run."""

    def __init__(self, words: list[list[bytes]], window: int):
        sizes = np.array([len(w) for w in words], np.int64)
        self.begin = np.cumsum(sizes) - sizes
        self.hashes = word_hashes([w for ws in words for w in ws])
        self.window = window
        run = np.repeat(np.arange(len(words)), sizes)
        n = max(len(run) - window + 1, 0)
        self.starts = np.nonzero(run[:n] == run[window - 1 :])[0]
        self.run = run[self.starts]

    def lane(self, lane: int, length: int) -> np.ndarray:
        return grams(np.ascontiguousarray(self.hashes[:, lane]), length, lane)

    def candidates(self, length: int) -> tuple[np.ndarray, ...]:
        """(run, seed, lo, hi): ranges of starts, counted from the run's first word, that look at one shorter window."""
        seeds = self.lane(0, length)
        seen = leftmost_min(seeds, self.window - length + 1)[self.starts]
        fresh = np.ones(len(seen), bool)
        fresh[1:] = (seen[1:] != seen[:-1]) | (self.run[1:] != self.run[:-1])
        first, last = np.nonzero(fresh)[0], np.nonzero(np.append(fresh[1:], True)[: len(seen)])[0]
        run = self.run[first]
        return run, seeds[seen[first]].view(np.int64), self.starts[first] - self.begin[run], self.starts[last] - self.begin[run] + 1


# -- blocks -------------------------------------------------------------------------------------------------------


def seal(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue())


def unseal(sealed: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(sealed)).read_all().combine_chunks()


def texts_of(rows: pa.Table) -> pa.Array:
    """The texts (column 1) as bytes."""
    return rows.column(1).combine_chunks().cast(pa.binary())


def runs(texts: pa.Array) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Words of the texts, about RUN bytes at a time, with the first text's position."""
    at, held, n = 0, [], 0
    for i, t in enumerate(texts):
        raw = t.as_py() or b""
        held.append(raw.split())  # of bytes: exactly the six ASCII white space characters
        n += len(raw)
        if n >= RUN:
            yield at, held
            at, held, n = i + 1, [], 0
    if held:
        yield at, held


def _gather(window: int) -> Callable:
    """Rows with the text in column 1 -> blocks: block, sealed, docs (digest, words and first-level candidates)."""
    kind = pa.struct([("dg", pa.binary()), ("n_words", pa.int64()), ("found", pa.list_(pa.struct([("seed", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])))])

    def facts(rows: pa.Table) -> pa.Array:
        digests, n_words, counts, found = [], [], [], []
        for _, words in runs(texts_of(rows)):
            long = [i for i, w in enumerate(words) if len(w) >= window]
            run, *rest = Runs([words[i] for i in long], window).candidates(levels(window)[0])
            per = np.zeros(len(words), np.int64)
            per[long] = np.bincount(run, minlength=len(long))
            counts.append(per)
            found.append(rest)
            digests += [digest_of(w) if len(w) >= window else None for w in words]
            n_words += [len(w) for w in words]
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        seed, lo, hi = (np.concatenate(x) for x in zip(*found))
        each = pa.StructArray.from_arrays([pa.array(seed), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], ["seed", "lo", "hi"])
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), each)
        return pa.StructArray.from_arrays([pa.array(digests, pa.binary()), pa.array(n_words, pa.int64()), lists], ["dg", "n_words", "found"])

    def block(key: int, rows: pa.Table) -> pa.RecordBatch:
        docs = pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), facts(rows).cast(kind))
        return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([seal(rows)], pa.binary()), docs], ["block", "sealed", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            at = 0
            for i, b in enumerate(pa.compute.binary_length(batch.column(1)).fill_null(0).to_pylist()):
                size += b
                if size >= BLOCK:
                    yield block((part << 32) + n, pa.Table.from_batches([*held, batch.slice(at, i + 1 - at)]))
                    n, held, size, at = n + 1, [], 0, i + 1
            if at < batch.num_rows:
                held.append(batch.slice(at))
        if held:
            yield block((part << 32) + n, pa.Table.from_batches(held))

    return run


def _surviving(left: pa.Table, right: pa.Table, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, Runs, np.ndarray, np.ndarray]]:
    """Of a block and its surviving ranges, some at a time: (at, first word and dup of each run, Runs, hot by window, number of run by window)."""
    if not left.num_rows or not right.num_rows:
        return
    texts = texts_of(unseal(left.column("sealed")[0].as_py()))
    at, lo, hi, dup, hot = (right.column(c).to_numpy() for c in ("at", "lo", "hi", "dup", "hot"))
    order = np.lexsort([lo, at])
    at, lo, hi, dup, hot = (x[order] for x in (at, lo, hi, dup, hot))
    head = np.ones(len(at), bool)  # ranges that touch are one run
    head[1:] = (at[1:] != at[:-1]) | (lo[1:] != hi[:-1])
    first = np.nonzero(head)[0]
    stop = hi[np.append(first[1:], len(at)) - 1]
    heat = np.repeat(hot, hi - lo)  # of all windows in order
    done, some, size, begun, last, words = 0, [], 0, 0, -1, []
    for k, i in enumerate(first):
        if at[i] != last:
            last, words = at[i], (texts[int(at[i])].as_py() or b"").split()
        some.append(words[lo[i] : stop[k] + window - 1])
        size += len(some[-1])
        if size >= RUN // 8 or k == len(first) - 1:
            held = first[begun : k + 1]
            r = Runs(some, window)
            yield at[held], lo[held], dup[held], r, heat[done : done + len(r.starts)]
            done, some, size, begun = done + len(r.starts), [], 0, k + 1


def _extend(window: int, length: int) -> Callable:
    """A block and surviving ranges of starts -> the candidates of a longer window: block, at, dup, seed, lo, hi."""
    names = ["block", "at", "dup", "seed", "lo", "hi"]
    schema = pa.schema([("block", pa.int64()), ("at", pa.int32()), ("dup", pa.bool_()), ("seed", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for at, begin, dup, r, _ in _surviving(left, right, window):
            k, seed, lo, hi = r.candidates(length)
            columns = [np.full(len(k), left.column("block")[0].as_py(), np.int64), at[k].astype(np.int32), dup[k], seed, (begin[k] + lo).astype(np.int32), (begin[k] + hi).astype(np.int32)]
            out.append(pa.table(dict(zip(names, columns)), schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


def _targets(window: int) -> Callable:
    """A block and surviving ranges of starts -> the target windows: x, y (lanes), block, at, pos, hot, dup."""
    names = ["x", "y", "block", "at", "pos", "hot", "dup"]
    schema = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("block", pa.int64()), ("at", pa.int32()), ("pos", pa.int32()), ("hot", pa.bool_()), ("dup", pa.bool_())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for at, begin, dup, r, hot in _surviving(left, right, window):
            x, y = (r.lane(lane, window)[r.starts].view(np.int64) for lane in (0, 1))
            pos = begin[r.run] + r.starts - r.begin[r.run]
            columns = [x, y, np.full(len(x), left.column("block")[0].as_py(), np.int64), at[r.run].astype(np.int32), pos.astype(np.int32), hot, dup[r.run]]
            out.append(pa.table(dict(zip(names, columns)), schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


def spans(at: list[int], window: int) -> list[tuple[int, int]]:
    """Word ranges [a, b) covered by windows at the given starts."""
    out: list[list[int]] = []
    for a in sorted(at):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], a + window)
        else:
            out.append([a, a + window])
    return [(a, b) for a, b in out]


def _finish(window: int, digest: bool) -> Callable:
    """A block and its marks (at, pos; -1: all words go) -> doc_id, n_words, n_removed, spans, kept, carry.

    kept: the kept words joined by one space, as SHA-256 with digest; else the text itself where nothing goes.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = unseal(left.column("sealed")[0].as_py())
        marks: dict[int, list[int]] = {}
        for at, pos in zip(right.column("at").to_pylist(), right.column("pos").to_pylist()):
            marks.setdefault(at, []).append(pos)
        total, removed, ranges, kept = [], [], [], []
        for i, text in enumerate(texts_of(rows)):
            raw, at = text.as_py() or b"", marks.get(i)
            words = raw.split()
            got = [] if not at else [(0, len(words))] if -1 in at else spans(at, window)
            last, left_over = 0, []
            for a, b in got:
                left_over += words[last:a]
                last = b
            left_over += words[last:]
            total.append(len(words))
            removed.append(len(words) - len(left_over))
            ranges.append([{"start": a, "stop": b} for a, b in got])
            whole = b" ".join(left_over) if got or digest else raw
            kept.append(hashlib.sha256(whole).hexdigest() if digest else whole.decode())
        others = [rows.column(k).combine_chunks() for k in range(2, rows.num_columns)]
        span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
        out = [rows.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(ranges, pa.list_(span)), pa.array(kept, pa.string()), *others]
        return pa.table(out, names=["doc_id", "n_words", "n_removed", "spans", "kept", *[f"c{k}" for k in range(len(others))]])

    return run


# -- the search ---------------------------------------------------------------------------------------------------


def _at_blocks(blocks: DataFrame, rows: DataFrame, work: Callable, schema) -> DataFrame:
    """Cogroup by block; the bucketed blocks stay where they lie."""
    return blocks.select("block", "sealed").groupBy("block").cogroup(rows.withColumnRenamed("block", "asker").groupBy("asker")).applyInArrow(work, schema)


def surviving(found: DataFrame, scratch: Scratch) -> DataFrame | None:
    """Of candidates (block, at, dup, seed, lo, hi), those whose seed occurs again, with hot; None if there are none."""
    again = scratch.save(found.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "again")
    if again.isEmpty():
        return None
    n = found.count()
    hot = (F.col("n") > max(n // common.HOT_SHARE, 1)).alias("hot")
    return join_unique(found, again, "seed", n, "n").select("block", "at", "dup", "lo", "hi", hot)


def target_marks(windows: DataFrame) -> DataFrame:
    """(block, at, pos) of target windows that occur again.

    Under a cold candidate no group exceeds the candidate's own count. Under a hot one windows first meet by salt, and
    then one row a salt, so that neither group grows with the corpus's copies.
    """
    place = ["block", "at", "pos"]
    cold = windows.filter(~F.col("hot")).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("x", "y")))
    cold = cold.filter("n > 1").filter(~F.col("dup")).select(*place)
    met = Window.partitionBy("x", "y", "salt")
    hot = windows.filter("hot").withColumn("salt", F.pmod(F.xxhash64(*place), F.lit(SALTS)))
    hot = hot.withColumn("n", F.count(F.lit(1)).over(met)).withColumn("first", F.row_number().over(met.orderBy(*place)) == 1)
    apart = F.when(F.col("first"), F.lit(0)).otherwise(F.xxhash64(*place))
    hot = hot.withColumn("salts", F.count(F.lit(1)).over(Window.partitionBy("x", "y", apart)))
    hot = hot.filter(~F.col("dup") & ((F.col("n") > 1) | (F.col("salts") > 1))).select(*place)
    return cold.unionByName(hot)


def repeated_words(
    docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", digest: bool = False
) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, spans (removed word ranges), kept, and c0, c1, ...: the other columns.

    kept is the remaining text, or with digest its SHA-256 after joining the kept words by one space; then the other
    columns are left out.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring")
    others = [] if digest else [c for c in docs.columns if c not in (id_col, text_col)]
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)])
    blocks = scratch.bucketed(
        rows.mapInArrow(_gather(window), "block long, sealed binary, docs array<struct<dg: binary, n_words: long, found: array<struct<seed: long, lo: int, hi: int>>>>"),
        "block",
        text_bytes(docs, text_col),
    )
    held = blocks.select("block", F.posexplode("docs").alias("at", "d")).filter("d.dg is not null")
    # one row a word sequence: how many documents hold it, one of them, its candidates
    distinct = held.groupBy("d.dg").agg(F.count(F.lit(1)).alias("n_docs"), F.min(F.struct("block", "at")).alias("one"), F.first("d.found").alias("found"))
    distinct = scratch.save(distinct, "distinct")
    n_docs = distinct.agg(F.sum("n_docs")).first()[0] or 0
    copied = scratch.save(distinct.filter("n_docs > 1").select("dg", "n_docs"), "copied")
    place = [F.col("one.block").alias("block"), F.col("one.at").alias("at"), (F.col("n_docs") > 1).alias("dup")]
    found = distinct.select(*place, F.inline("found"))
    first, *more = levels(window)
    ranges = surviving(found, scratch)
    for length in more[:-1]:
        if ranges is None:
            break
        found = scratch.save(_at_blocks(blocks, ranges, _extend(window, length), f"block long, at int, dup boolean, {CANDIDATE}"), f"length{length}")
        ranges = surviving(found, scratch)
    gone = join_unique(held.select("block", "at", F.col("d.dg").alias("dg")), copied, "dg", n_docs, "n_docs").select("block", "at", F.lit(-1).alias("pos"))
    marks = gone
    if ranges is not None:
        windows = _at_blocks(blocks, ranges, _targets(window), "x long, y long, block long, at int, pos int, hot boolean, dup boolean")
        marks = gone.unionByName(target_marks(windows))
    span = StructType([StructField("start", LongType()), StructField("stop", LongType())])
    shape = StructType(
        [
            StructField("doc_id", rows.schema["doc_id"].dataType),
            StructField("n_words", LongType()),
            StructField("n_removed", LongType()),
            StructField("spans", ArrayType(span)),
            StructField("kept", StringType()),
            *rows.schema.fields[2:],
        ]
    )
    return _at_blocks(blocks, marks, _finish(window, digest), shape)


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the repeated words, all columns in place; documents that lose every word go."""
    got = repeated_words(docs, window, id_col, text_col).filter((F.col("n_removed") < F.col("n_words")) | (F.col("n_words") == 0))
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    place = {id_col: "doc_id", text_col: "kept", **{c: f"c{k}" for k, c in enumerate(others)}}
    return got.select(*[F.col(place[c]).alias(c) for c in docs.columns])
