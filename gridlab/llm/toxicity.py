"""Toxicity by weak supervision.

Many voters look at a text: single lexicon entries, groups of rarer entries, and patterns. A generative label
model, fitted by expectation-maximisation, estimates how often each voter fires on toxic and on other texts, and how
that depends on the voter it is most tied to within a class: accuracies and correlations are its parameters. Its
posterior labels train a linear classifier on the voters' findings, which gives the score.

The lexicon is a seed of plain insults plus words and word beginnings that the training labels mark, chosen by
their log-likelihood ratio. An entry needs a few toxic texts, whatever share of all they are, so the vocabulary of a
language with few texts is found too; copies of a text count as one, lest their other words pass for toxic. Fitting
reads at most fit_toxic and fit_other labelled documents in expectation, which bounds the one task that fits; scoring
covers every whole text.

Defined cases: a null or empty text has no findings and takes the classifier's base score; null labels are left
out, and of several labels of an id the largest counts; with no training rows the seed lexicon alone decides; texts of
any length are searched whole; repeated rows score alike; an empty table gives an empty result. Only id and text are
read from docs, so other columns can't clash.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices

#: Labelled documents that a fit reads at most, in expectation: toxic ones, others.
FIT_TOXIC, FIT_OTHER = 1500, 4500


@dataclass(frozen=True)
class Cuts:
    """What a mined lexicon entry needs, and how many entries there are at most.

    least: log-likelihood ratio; count: toxic texts that hold it (copies of a text count once); lift: how many times
    its rate in other texts its rate in toxic ones must be.
    """

    entries: int = 400
    least: float = 20.0
    count: int = 5
    lift: float = 8.0


#: Bands, and smallest hashes of a text's word triples in each; texts that share a band are copies.
BANDS, BAND = 6, 3
#: Entries that vote alone, grouped voters.
ALONE, GROUPS = 32, 8
#: Lengths of word beginnings that may be mined.
PREFIXES = (4, 5, 6, 7)
THRESHOLD = 0.7
SEED = "idiot moron stupid dumb fool loser trash scum worthless pathetic disgusting clown jerk ugly".split()
WORDS = re.compile(r"[^\W\d_]+")
SHOUT = re.compile(r"[^\W\d_]{3,}!!")
MASKED = re.compile(r"\w[*#$%&]{2,}")
ADDRESS = re.compile(r"\b(?:you|your|tu|vous|du|ihr|usted|vosotros)\b")
EXTRA = ("dense", "shouting", "masked", "address", "none")


def features(text: str) -> set[str]:
    """Words as 'w:...' and word beginnings as 'p:...'."""
    out = set()
    for w in set(WORDS.findall(text.lower())):
        out.add("w:" + w)
        out.update("p:" + w[:n] for n in PREFIXES if len(w) > n)
    return out


def ratio(a: int, c: int, toxic: int, other: int) -> float:
    """Log-likelihood ratio of a feature seen in a of `toxic` and c of `other` documents; 0 if it favours others."""
    if a * other <= c * toxic:
        return 0.0
    n, row = toxic + other, a + c
    cells = ((a, toxic, row), (c, other, row), (toxic - a, toxic, n - row), (other - c, other, n - row))
    return 2 * sum(x * math.log(x * n / (col * r)) for x, col, r in cells if x)


def sketch(text: str) -> list[tuple[int, ...]]:
    """The smallest of each of BANDS * BAND hashes over the triples of words, by bands."""
    words = text.lower().split()
    triples = {" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))}
    h = np.array([xxhash.xxh3_64_intdigest(x) for x in triples], np.uint64)
    least = [int((h * np.uint64(0x9E3779B97F4A7C15 + 2 * k) ^ (h >> np.uint64(29 + k))).min()) for k in range(BANDS * BAND)]
    return [tuple(least[i : i + BAND]) for i in range(0, BANDS * BAND, BAND)]


def copies(texts: list[str]) -> list[int]:
    """For each text, the first one that it is a copy of, by a chain of shared bands."""
    root, seen = list(range(len(texts))), {}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for i, t in enumerate(texts):
        for key in enumerate(sketch(t)):
            a, b = sorted((find(i), find(seen.setdefault(key, i))))
            root[b] = a
    return [find(i) for i in range(len(texts))]


def spread(texts: list[str], only: Counter | None = None) -> tuple[Counter, int]:
    """How many texts hold a feature, copies counted once, and how many texts there are."""
    groups: dict[int, set[str]] = {}
    for t, first in zip(texts, copies(texts)):
        held = features(t)
        groups.setdefault(first, set()).update(held if only is None else (f for f in held if f in only))
    return Counter(f for g in groups.values() for f in g), len(groups)


def mine(texts: list[str], toxic: list[bool], cuts: Cuts = Cuts()) -> list[str]:
    """Lexicon entries, strongest first; an entry that a stronger beginning covers is left out."""
    yes, n = spread([t for t, y in zip(texts, toxic) if y])
    yes = Counter({f: a for f, a in yes.items() if a >= cuts.count})
    no, m = spread([t for t, y in zip(texts, toxic) if not y], yes)
    scored = sorted((-ratio(a, no[f], n, m), f) for f, a in yes.items() if cuts.lift * no[f] * n <= a * max(m, 1))
    out: list[str] = []
    begun: set[str] = set()
    for g, f in scored:
        word = f[2:]
        if -g < cuts.least or len(out) >= cuts.entries:
            break
        if any(word[:k] in begun for k in range(3, len(word) + 1)) or (f[0] == "p" and any(w[2:].startswith(word) for w in out)):
            continue
        out.append(f)
        if f[0] == "p":
            begun.add(word)
    return out


class Finder:
    """Hits of lexicon entries in a text, by one automaton."""

    def __init__(self, entries: list[str]):
        import ahocorasick

        self.n = len(entries)
        self.whole = [e[0] == "w" for e in entries]
        self.machine = ahocorasick.Automaton()
        by_text: dict[str, list[int]] = {}
        for i, e in enumerate(entries):
            by_text.setdefault(e[2:], []).append(i)
        for t, some in by_text.items():
            self.machine.add_word(t, (len(t), some))
        if by_text:
            self.machine.make_automaton()

    def hits(self, text: str) -> Counter:
        found: Counter = Counter()
        if not self.n:
            return found
        letter = lambda i: 0 <= i < len(text) and text[i].isalpha()
        for end, (size, some) in self.machine.iter(text):
            if letter(end - size):
                continue
            for i in some:
                if letter(end + 1) != self.whole[i]:
                    found[i] += 1
        return found


class Voters:
    def __init__(self, entries: list[str]):
        self.entries = entries
        self.finder = Finder(entries)
        self.alone = min(ALONE, len(entries))
        self.size = self.alone + GROUPS + len(EXTRA)

    def look(self, text: str) -> np.ndarray:
        """Votes (0 or 1) of all voters, then the classifier's measurements."""
        out = np.zeros(self.size + 4)
        low = text.lower()
        hits = self.finder.hits(low)
        for i in hits:
            out[i if i < self.alone else self.alone + i % GROUPS] = 1
        total, words = sum(hits.values()), low.count(" ") + 1
        at = self.alone + GROUPS
        out[at : at + len(EXTRA)] = (
            total >= 2 and 100 * total > words,
            bool(SHOUT.search(text)),
            bool(MASKED.search(text)),
            bool(ADDRESS.search(low)),
            total == 0,
        )
        out[self.size :] = (min(total, 1), math.log1p(total), math.log1p(len(hits)), 10 * total / (words + 10))
        return out


def forest(votes: np.ndarray, classes: tuple[np.ndarray, np.ndarray], first: int = 0) -> np.ndarray:
    """Each voter's parent (-1: none) in the forest of the strongest dependences that remain within the classes.

    A dependence is the mutual information of two voters given the class; it counts if it pays for its two further
    parameters (Bayesian information criterion). Edges are taken by strength as long as they close no circle. Voters
    before `first` take no part.
    """
    n, m = votes.shape
    gain = np.zeros((m, m))
    for p in classes:
        size = max(p.sum(), 1e-9)
        on = p @ votes / size
        both = (votes * p[:, None]).T @ votes / size
        for cell, row, col in (
            (both, on, on),
            (on[:, None] - both, on, 1 - on),
            (on[None, :] - both, 1 - on, on),
            (1 - on[:, None] - on[None, :] + both, 1 - on, 1 - on),
        ):
            chance = np.maximum(np.outer(row, col), 1e-12)
            gain += size * np.where(cell > 1e-9, cell * np.log(np.maximum(cell, 1e-12) / chance), 0)
    tied = [(g, i, j) for i in range(first, m) for j in range(first, i) if (g := gain[i, j]) > math.log(max(n, 2))]
    group, near = list(range(m)), [[] for _ in range(m)]
    for _, i, j in sorted(tied, reverse=True):
        if group[i] != group[j]:
            near[i].append(j)
            near[j].append(i)
            group = [group[i] if g == group[j] else g for g in group]
    parent = np.full(m, -1)
    done: set[int] = set()
    for root in range(m):
        todo = [] if root in done else [root]
        done.update(todo)
        while todo:
            i = todo.pop()
            for j in near[i]:
                if j not in done:
                    parent[j] = i
                    done.add(j)
                    todo.append(j)
    return parent


def label_model(votes: np.ndarray, lexicon: int, base: float, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior probability of the toxic class by text, fire, parent), from votes alone, by expectation-maximisation.

    A voter's rate depends on the class and on the vote of its parent in a forest, so both its accuracy and its
    correlation are parameters: fire[c, v, i] is the rate of voter i in class c (0: toxic) where its parent votes v;
    without a parent both v are alike. The forest is found before the first round for the
    other voters than the first `lexicon`, lest those that repeat each other pull the classes their way, and anew for
    all at a third and two thirds of the rounds. The first `lexicon` voters start as evidence for the class, so that
    nothing can be said of their own ties then; base is the class balance, which votes alone don't settle.
    """
    m = votes.shape[1]
    post, parent = np.where(votes[:, :lexicon].any(1), 0.95, 0.05), np.full(m, -1)
    for k in range(rounds):
        classes = (post, 1 - post)
        if not k:
            sure = (post > 0.5).astype(float)  # the start is no posterior: its unsure share would tie what only the class ties
            parent = forest(votes, (sure, 1 - sure), lexicon)
        elif k in (rounds // 3, 2 * rounds // 3):
            parent = forest(votes, classes)
        above = np.where(parent >= 0, votes[:, parent], 0)
        fire = np.zeros((2, 2, m))
        for c, p in enumerate(classes):
            alone = (p @ votes + 0.5) / (p.sum() + 1.0)
            for v, part in enumerate((1 - above, above)):
                size, hits = p @ part, p @ (part * votes)
                fire[c, v] = np.where(parent >= 0, (hits + alone) / (size + 1.0), alone)  # one vote's worth of the plain rate
        fire = np.clip(fire, 1e-4, 1 - 1e-4)
        held = [np.where(above > 0, fire[c, 1], fire[c, 0]) for c in (0, 1)]
        says = np.where(votes > 0, np.log(held[0] / held[1]), np.log((1 - held[0]) / (1 - held[1])))
        odds = math.log(base / (1 - base)) + says.sum(1)
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return post, fire, parent


def linear(x: np.ndarray, y: np.ndarray, penalty: float = 0.3, rounds: int = 30) -> np.ndarray:
    """Logistic regression on soft labels by Newton's method; the last coefficient is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * b)
        b += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return b


def fit(texts: list[str], toxic: list[bool], cuts: Cuts = Cuts()) -> dict:
    """The model as plain lists: entries, coefficients, and the label model's rates and parents of the voters."""
    mined = mine(texts, toxic, cuts) if any(toxic) else []
    entries = mined + [f"w:{w}" for w in SEED if f"w:{w}" not in mined]
    voters = Voters(entries)
    seen = np.array([voters.look(t) for t in texts]) if texts else np.zeros((0, voters.size + 4))
    if not len(seen) or not seen[:, voters.size].any():
        coef = np.zeros(voters.size + 5)
        coef[voters.size], coef[-1] = 4.0, -3.0
        return {"entries": entries, "coef": coef.tolist(), "fire": [], "parent": []}
    base = min(max(sum(toxic) / len(toxic), 0.01), 0.99)
    post, fire, parent = label_model(seen[:, : voters.size], voters.alone + GROUPS, base)
    return {"entries": entries, "coef": linear(seen, post).tolist(), "fire": fire.tolist(), "parent": parent.tolist()}


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    fit_toxic: int = FIT_TOXIC,
    fit_other: int = FIT_OTHER,
    cuts: Cuts = Cuts(),
) -> dict:
    """Fit on docs that labels (already restricted to training rows) mark 0 or 1, at most so many of either in expectation."""
    known = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).dropna().groupBy("i").agg(F.max("y").alias("y"))
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a class
    uniform = F.pmod(F.xxhash64("i"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    most = F.when(F.col("y") == 1, fit_toxic / max(sizes.get(1, 0), 1)).otherwise(fit_other / max(sizes.get(0, 0), 1))
    chosen = known.filter(uniform < most)  # at most fit_toxic + fit_other ids in expectation
    sample = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "i").select("text", "y")

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["text", "y"])
        return pd.DataFrame({"model": [json.dumps(fit([t or "" for t in pdf["text"]], [y == 1 for y in pdf["y"]], cuts))]})

    got = sample.groupBy().applyInPandas(learn, "model string").first()
    return json.loads(got["model"]) if got else fit([], [], cuts)


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score for every row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # at most cuts.entries entries and the seed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters, coef = Voters(held.value["entries"]), np.array(held.value["coef"])
        for batch in batches:
            for at, texts in slices(batch.column(1).to_pylist()):
                x = np.array([voters.look(t) for t in texts])
                odds = x @ coef[:-1] + coef[-1]
                got = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(got)], ["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
