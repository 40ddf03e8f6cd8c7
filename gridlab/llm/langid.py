"""Language identification by segmentation-marginalised unigrams.

A language is a distribution over the pieces of a fixed public byte vocabulary. The probability of a word is the
sum over all its segmentations into pieces, computed by a forward pass over its bytes; words are independent, so
a text's score in a language is the sum of its words' log probabilities. Piece probabilities come from
expectation-maximisation over the training words, which climbs the same marginal likelihood that scores: the forward
sums of a word and of its mirror image give each piece's expected count. Two rounds let the second start from the
pieces' own frequencies; on the given data one, two and four rounds predict alike.

Words are runs of letters (Unicode category L), whole at any length: they are worked on in blocks of words of like
length, and sums are rescaled every EVERY bytes, so that long words neither underflow nor waste memory. Every piece of
the vocabulary takes part.

Training reads at most fit_docs documents of a language in expectation (taken by a hash of the id), which bounds
the one task that fits. Scoring covers every whole text; workers keep a bounded cache of word scores.

Defined cases: a null text, or one without a letter, is `und` with score 0; ties go to the language that sorts
first; with no training rows every text is `und`; repeated rows score alike; an empty table gives an empty
result. Only id, text and, for training, lang are read, so other columns can't clash.
"""

from __future__ import annotations

import base64
import json
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .trie import Trie

FIT_DOCS = 1500
#: Expectation-maximisation rounds from equal probabilities, added count of each piece in a language.
ROUNDS, FLOOR = 2, 0.05
#: Words in a worker's cache before it starts afresh; longer words are not kept.
CACHE_WORDS, CACHE_LETTERS = 400_000, 100
#: Bytes between rescalings, and the numbers (positions times words times languages) of a block of words.
EVERY, BLOCK = 16, 2_000_000


def read_pieces(vocabulary: str) -> list[bytes]:
    """The pieces of a tiktoken rank file, in order of rank."""
    lines = (line.split() for line in Path(vocabulary).read_bytes().splitlines() if line)
    return [base64.b64decode(a) for a, _ in lines]


@cache
def letters() -> re.Pattern:
    """Runs of code points of category L: word characters but for digits, other numbers and the low line."""
    other = [c for c in range(sys.maxunicode + 1) if chr(c).isalnum() and not unicodedata.category(chr(c)).startswith("L")]
    starts = [c for c, before in zip(other, [-1, *other]) if c != before + 1]
    stops = [c for c, after in zip(other, [*other[1:], -1]) if after != c + 1]
    return re.compile("[^\\W_" + "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, stops)) + "]+")


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters; each stands for itself with a space before."""
    return letters().findall(text.lower())


class Lattice:
    """Sums over all segmentations of many words at once, for every language."""

    def __init__(self, pieces: list[bytes]):
        self.trie = Trie({p: i for i, p in enumerate(pieces)})
        self.longest = max(map(len, pieces), default=1)

    def blocks(self, words: list[str], languages: int) -> Iterator[tuple[np.ndarray, list[bytes]]]:
        """Words of like length, as positions in the list and as bytes after a space."""
        raw = [b" " + w.encode() for w in words]
        order = sorted(range(len(raw)), key=lambda i: len(raw[i]))
        at = 0
        while at < len(order):
            n = 1  # a block's last word is its longest
            while at + n < len(order) and (n + 1) * (len(raw[order[at + n]]) + 1) * languages <= BLOCK:
                n += 1
            yield np.array(order[at : at + n]), [raw[i] for i in order[at : at + n]]
            at += n

    def edges(self, raw: list[bytes]) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        """Sizes, and every piece in every word as (start, end, word, piece), by start."""
        sizes = np.array([len(b) for b in raw], np.int64)
        flat = np.frombuffer(b"".join(raw) + bytes(self.longest), np.uint8)
        owner = np.repeat(np.arange(len(raw)), sizes)
        offset = np.arange(len(owner)) - (np.cumsum(sizes) - sizes)[owner]
        room = sizes[owner] - offset
        at, node, found = np.arange(len(owner)), np.zeros(len(owner), np.int32), []
        for depth in range(self.longest):
            node = self.trie.step(node, flat[at + depth])
            on = (node >= 0) & (room[at] > depth)
            at, node = at[on], node[on]
            if not len(at):
                break
            piece = self.trie.ends[node]
            hit = np.nonzero(piece >= 0)[0]
            found.append((offset[at[hit]], offset[at[hit]] + depth + 1, owner[at[hit]], piece[hit]))
        start, end, word, piece = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(start, kind="stable")
        return sizes, (start[order], end[order], word[order], piece[order])


def sums(sizes: np.ndarray, edges: tuple[np.ndarray, ...], prob: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(alpha, log): alpha[position, word, language] * exp(log[position // EVERY, word, language]) sums all segmentations
    of a word's first bytes; edges are by start."""
    start, end, word, piece = edges
    width, reach = int(sizes.max()), int((end - start).max(initial=1))
    alpha = np.zeros((width + 1, len(sizes), prob.shape[1]))
    log = np.zeros((width // EVERY + 1, *alpha.shape[1:]))
    alpha[0] = 1.0
    cut = np.searchsorted(start, np.arange(width + 2)).tolist()
    for i in range(width + 1):
        if i and i % EVERY == 0:  # all that is known of later positions moves to one scale
            ahead = alpha[i : i + reach]
            top = ahead.max(0)
            top[top == 0] = 1.0
            ahead /= top
            log[i // EVERY] = log[i // EVERY - 1] + np.log(top)
        here = slice(cut[i], cut[i + 1])
        if here.stop > here.start:  # (end, word) occur once among the pieces from one position
            alpha[end[here], word[here]] += alpha[i, word[here]] * prob[piece[here]]
    return alpha, log


def at_end(sizes: np.ndarray, alpha: np.ndarray, log: np.ndarray) -> np.ndarray:
    """log P(word | language) of each word."""
    every = np.arange(len(sizes))
    return np.log(np.maximum(alpha[sizes, every], 1e-300)) + log[sizes // EVERY, every]


def log_likelihood(lattice: Lattice, words: list[str], prob: np.ndarray) -> np.ndarray:
    out = np.zeros((len(words), prob.shape[1]))
    for at, raw in lattice.blocks(words, prob.shape[1]):
        sizes, edges = lattice.edges(raw)
        out[at] = at_end(sizes, *sums(sizes, edges, prob))
    return out


def expected_counts(lattice: Lattice, words: list[str], weight: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """Expected uses of each piece by language; weight[word, language] counts the words."""
    out = np.zeros(prob.shape)
    for at, raw in lattice.blocks(words, prob.shape[1]):
        sizes, edges = lattice.edges(raw)
        start, end, word, piece = edges
        alpha, log = sums(sizes, edges, prob)
        back_start, back_end = sizes[word] - end, sizes[word] - start  # the same pieces, read from the word's end
        order = np.argsort(back_start, kind="stable")
        beta, beta_log = sums(sizes, (back_start[order], back_end[order], word[order], piece[order]), prob)
        scale = log[start // EVERY, word] + beta_log[back_start // EVERY, word] - at_end(sizes, alpha, log)[word]
        gain = alpha[start, word] * prob[piece] * beta[back_start, word] * np.exp(scale) * weight[at][word]
        for la in range(prob.shape[1]):
            out[:, la] += np.bincount(piece, gain[:, la], len(prob))
    return out


def fit(counts: dict[str, Counter], pieces: list[bytes], rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages in order and prob[piece, language] by expectation-maximisation over counted words."""
    langs = sorted(counts)
    words = sorted(set().union(*counts.values())) if counts else []
    prob = np.full((len(pieces), max(len(langs), 1)), 1.0 / max(len(pieces), 1))
    if not words:
        return langs, prob
    lattice = Lattice(pieces)
    weight = np.array([[counts[la][w] for la in langs] for w in words], float)
    for _ in range(rounds):
        expected = expected_counts(lattice, words, weight, prob) + FLOOR
        prob = expected / expected.sum(0)
    return langs, prob


class Scorer:
    def __init__(self, pieces: list[bytes], langs: list[str], prob: np.ndarray):
        self.lattice, self.langs, self.prob = Lattice(pieces), langs, prob
        self.cache: dict[str, int] = {}
        self.rows = np.zeros((0, prob.shape[1]), np.float32)

    def score(self, texts: list[str]) -> list[tuple[str, float]]:
        words = [words_of(t) for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
            self.rows = self.rows[:0]
        new = list({w for ws in words for w in ws}.difference(self.cache))
        at = len(self.rows)
        self.rows = np.concatenate([self.rows, log_likelihood(self.lattice, new, self.prob).astype(np.float32)])
        self.cache.update(zip(new, range(at, at + len(new))))
        get, out = self.cache.__getitem__, []
        for ws in words:
            if not ws or not self.langs:
                out.append(("und", 0.0))
                continue
            total = self.rows[list(map(get, ws))].sum(0, dtype=np.float64)
            best = int(total.argmax())
            out.append((self.langs[best], float(1.0 / np.exp(total - total[best]).sum())))
        for w in new:
            if len(w) > CACHE_LETTERS:
                del self.cache[w]
        return out


def in_training(id_col: Column) -> Column:
    return (F.crc32(id_col.cast("string").cast("binary")) % 3 != 1) & id_col.isNotNull()


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_docs: int = FIT_DOCS) -> tuple[list[str], np.ndarray]:
    """Fit on rows of docs (already restricted to training rows) with a language."""
    pieces = read_pieces(vocabulary)
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("lang is not null and text is not null")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = F.lit(float(fit_docs)) / F.col("n")
    uniform = (F.pmod(F.xxhash64("i"), F.lit(1 << 30)) / F.lit(float(1 << 30)))
    sample = rows.join(F.broadcast(sizes), "lang").filter(uniform < share)  # one row a language

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        counts: dict[str, Counter] = {}
        for la, t in zip(pdf["lang"], pdf["text"]):
            counts.setdefault(la, Counter()).update(words_of(t))
        langs, prob = fit({la: c for la, c in counts.items() if c}, pieces)
        return pd.DataFrame({"langs": [json.dumps(langs)], "prob": [prob.tobytes()]})

    got = sample.select("lang", "text").groupBy().applyInPandas(learn, "langs string, prob binary").first()
    if got is None:
        return [], np.zeros((len(pieces), 1))
    langs = json.loads(got["langs"])
    return langs, np.frombuffer(bytes(got["prob"])).reshape(len(pieces), -1).copy()


def predict(docs: DataFrame, vocabulary: str, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every row of docs."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((read_pieces(vocabulary), *model))  # bounded by vocabulary times languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*held.value)
        for batch in batches:
            for at, texts in slices(batch.column(1).to_pylist()):
                got = scorer.score(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                    ["doc_id", "lang_pred", "score"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, lang_pred string, score double"
    )
