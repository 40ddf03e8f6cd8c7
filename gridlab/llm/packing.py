"""Packing tokenised documents into fixed-length sequences by shortest-pack-first over the length histogram.

A document is its ids, then END_ID; it is cut every `size` ids, so all pieces but the last are full. Placement
sees only the histogram of piece lengths: lengths go longest first, each into the packs that are shortest so far
among those with room, counted by pattern and never one by one. There are at most `size` lengths, and a length
opens at most one new pattern and splits at most one, so patterns stay bounded by the sequence size whatever the
corpus. Patterns then meet pieces by rank: the piece with rank r among those of its length takes the r-th slot
of that length. Ranks come from counts per (length, salt) and prefix sums over them in levels, so a length held by a
third of all pieces is spread over as many groups as the input asks for; a piece's own number salts it, so repeated
rows are spread like others.

Defined cases: a null or empty text is the single END_ID; repeated rows are packed once each; a text of any length is
cut into as many full pieces as it takes; an empty table gives an empty result; only id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import CACHE_WORDS, SETTLED, SPACE, Merges, _class, byte_alphabet, slices
from .common import Scratch

SIZE, END_ID = 2048, 1
#: Pieces a salt group holds on average when all pieces have one length, and salts that one prefix sum runs over.
SALT_ROWS, FAN = 256, 4096

L, N = _class("L"), _class("N")
#: The published word pattern of the vocabulary (text in lower case).
SETTLED_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^{SPACE}{L}{N}]+")
UNSETTLED = re.compile(f"[^\x00-{chr(SETTLED - 1)}]")


class WordBPE:
    """Ids of texts for a lower-casing word-level vocabulary with marked word ends.

    White space parts words, so each distinct run between white space is cut into words and merged once. Texts
    with a special token, or with a code point whose class may depend on the Unicode version before or after
    lower-casing, go to the library whole.
    """

    def __init__(self, blob: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(blob)
        model = json.loads(blob)["model"]
        mark, vocab = model["end_of_word_suffix"], model["vocab"]
        pairs = []
        for m in model["merges"]:
            x, y = m if isinstance(m, list) else m.split(" ")
            pairs.append((vocab[x], vocab[y], vocab[x + y]))
        self.merges = Merges(pairs, max(vocab.values()) + 1)
        chars = sorted((b, c) for c, b in byte_alphabet().items())
        self.unit = np.array([[vocab[c] for _, c in chars], [vocab[c + mark] for _, c in chars]], np.int32)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.chunks: dict[bytes, bytes] = {}

    def learn(self, chunks: list[bytes]) -> None:
        words = [[w.encode() for w in SETTLED_WORDS.findall(c.decode())] for c in chunks]
        raw = [w for ws in words for w in ws]
        flat, sizes = np.frombuffer(b"".join(raw), np.uint8), np.array([len(w) for w in raw], np.int64)
        last = np.zeros(len(flat), np.int8)
        last[np.cumsum(sizes) - 1] = 1
        ids, n = self.merges.merge(self.unit[last, flat], sizes)
        held = ids.astype("<u4").tobytes()
        per = np.bincount(np.repeat(np.arange(len(words)), [len(ws) for ws in words]), n, len(words)).astype(np.int64)
        stop = (4 * np.cumsum(per)).tolist()
        self.chunks.update(zip(chunks, [held[a:b] for a, b in zip([0, *stop], stop)]))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        small = [t.lower() for t in texts]
        plain = [not UNSETTLED.search(t) and not UNSETTLED.search(x) and not any(s in t for s in self.special) for t, x in zip(texts, small)]
        parts = [x.encode().split() if p else [] for x, p in zip(small, plain)]
        if len(self.chunks) > CACHE_WORDS:
            self.chunks.clear()
        missing = list({c for p in parts for c in p}.difference(self.chunks))
        if missing:
            self.learn(missing)
        get = self.chunks.__getitem__
        out = [
            b"".join(map(get, c)) if p else np.array(self.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
            for t, p, c in zip(texts, plain, parts)
        ]
        for c in missing:
            if len(c) > 200:
                del self.chunks[c]
        return out


_held: dict[str, WordBPE] = {}


def pieces(docs: DataFrame, vocabulary: str, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids, array of int): one row per piece."""
    blob = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_text())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hashlib.sha256(blob.value.encode()).hexdigest()
        bpe = _held[key] if key in _held else _held.setdefault(key, WordBPE(blob.value))
        end, step = np.array([END_ID], "<u4").tobytes(), 4 * size
        for batch in batches:
            names = batch.column(0)
            for at, part in slices(batch.column(1).to_pylist()):
                owner, start, length, crc, total, held = [], [], [], [], [], []
                for i, coded in enumerate(bpe.encode_batch(part)):
                    coded += end
                    n = len(coded) // 4
                    for a in range(0, len(coded), step):
                        piece = coded[a : a + step]
                        owner.append(at + i)
                        start.append(a // 4)
                        length.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                        total.append(n)
                        held.append(piece)
                out = [names.take(pa.array(owner, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
                cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if ids:
                    out.append(pa.array([np.frombuffer(p, "<u4").astype(np.int32) for p in held], pa.list_(pa.int32())))
                    cols.append("ids")
                yield pa.RecordBatch.from_arrays(out, cols)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * ids
    )


def pack_histogram(histogram: dict[int, int], size: int = SIZE) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Packing patterns as (((length, pieces), ...), sequences).

    Open patterns are kept by the room they leave. The shortest pack so far has the most room, so a length goes
    to the roomiest pattern; as many pieces as fit go into each of its sequences at once.
    """
    open_: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
    done: list[tuple[tuple[tuple[int, int], ...], int]] = []

    def put(room: int, pattern: tuple[tuple[int, int], ...], n: int) -> None:
        if n:
            (open_.setdefault(room, []) if room else done).append((pattern, n))

    for length in sorted(histogram, reverse=True):
        if not 0 < length <= size:
            raise ValueError(f"a piece of {length} ids can't be placed in {size}")
        left = histogram[length]
        while left:
            room = max(open_, default=0)
            if room < length:
                each, n, pattern, room = size // length, 0, (), size
                n, odd = divmod(left, each)
                put(size - each * length, ((length, each),), n)
                put(size - odd * length, ((length, odd),), 1 if odd else 0)
                left = 0
                continue
            pattern, n = open_[room].pop()
            if not open_[room]:
                del open_[room]
            take = min(n, left)  # one piece a sequence; they come round again while they stay the shortest
            put(room, pattern, n - take)
            put(room - length, (*pattern, (length, 1)), take)
            left -= take
    return done + [x for r in sorted(open_) for x in open_[r]]


def slots(patterns: list[tuple[tuple[tuple[int, int], ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset, pieces a sequence) of each run of equal slots."""
    used: dict[int, int] = {}
    out, base = [], 0
    for pattern, n in patterns:
        offset = 0
        for length, each in pattern:
            first = used.get(length, 0)
            used[length] = first + each * n
            out.append((length, first, first + each * n, base, offset, each))
            offset += each * length
        base += n
    return out


def ranked(rows: DataFrame, by: str, unique: str, n: int, scratch: Scratch) -> DataFrame:
    """rows with `rank`, 0 first within each value of `by`, in an order that follows from the unique column.

    Rows are dealt to salts by a hash of it. Where a salt begins comes from prefix sums over counts in levels, each
    group of FAN salts being one row of the next level, so no window holds more than FAN counts or a salt's rows.
    """
    salts = max(n // SALT_ROWS, 1)
    salted = rows.withColumn("s0", F.pmod(F.xxhash64(unique), F.lit(salts)))
    counts, level = [salted.groupBy(by, "s0").agg(F.count(F.lit(1)).alias("n"))], 0
    while salts > FAN:
        up = F.floor(F.col(f"s{level}") / FAN).cast("long").alias(f"s{level + 1}")
        held = scratch.save(counts[-1].select(by, f"s{level}", up, "n"), f"counts{level}")
        counts[-1] = held
        counts.append(held.groupBy(by, f"s{level + 1}").agg(F.sum("n").alias("n")))
        salts, level = -(-salts // FAN), level + 1
    base = None
    for k in range(level, -1, -1):
        group = [by] if k == level else [by, f"s{k + 1}"]
        ahead = Window.partitionBy(*group).orderBy(f"s{k}").rowsBetween(Window.unboundedPreceding, -1)
        own = counts[k].withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
        if base is not None:
            own = own.join(base, group).withColumn("ahead", F.col("ahead") + F.col("base"))
        base = own.select(by, f"s{k}", F.col("ahead").alias("base"))
    base = scratch.save(base, "base")
    inside = Window.partitionBy(by, "s0").orderBy(unique)
    return (
        salted.withColumn("inside", F.row_number().over(inside) - 1)
        .join(base, [by, "s0"])
        .withColumn("rank", F.col("base") + F.col("inside"))
        .drop("s0", "base", "inside")
    )


def pack(docs: DataFrame, vocabulary: str, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """The pieces with sequence_id, offset and sequence_tokens, the ids that their sequence holds."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    cut = scratch.save(pieces(docs, vocabulary, size, id_col, text_col, ids).withColumn("piece", F.monotonically_increasing_id()), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `size` rows
    patterns = pack_histogram(histogram, size)
    runs = spark.createDataFrame(
        slots(patterns) or [], "length long, first long, last long, base long, at long, each long"
    )  # bounded: see pack_histogram
    filled, base = [], 0
    for pattern, n in patterns:
        filled.append((base, base + n, sum(a * b for a, b in pattern)))
        base += n
    totals = dict((b, t) for b, _, t in filled)
    sizes = spark.createDataFrame(list(totals.items()), "base long, sequence_tokens long")
    placed = ranked(cut, "length", "piece", sum(histogram.values()), scratch).alias("p")
    runs = runs.join(F.broadcast(sizes), "base").alias("r")
    k = F.col("rank") - F.col("first")
    return placed.join(
        F.broadcast(runs),
        (F.col("p.length") == F.col("r.length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")),
    ).select(
        "p.doc_id",
        "start",
        "p.length",
        "ids_crc32",
        "doc_tokens",
        (F.col("base") + F.floor(k / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + (k % F.col("each")) * F.col("p.length")).alias("offset"),
        "sequence_tokens",
        *(["ids"] if ids else []),
    )
