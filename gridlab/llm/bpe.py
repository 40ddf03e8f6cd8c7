"""Byte-level BPE, encoding by speculation and verification.

Distinct words of a batch are cut greedily into the longest vocabulary entries. A proposal is the true encoding
exactly when every token is its own encoding and every adjacent pair is compatible, that is, when merging the
pair's bytes alone gives that pair back. All adjacent pairs of a batch are tested together in NumPy by walking
the merge trees on both sides of the seam; only words with a failing pair are merged exactly. Results are kept
in a bounded word cache in each Python worker. The vocabulary file is a parameter and goes to the workers with
the closure; it is bounded by its own size.

Defined cases: a null text counts as empty, which has no ids; repeated rows give equal results; texts of any
length are read whole; an empty table gives an empty result. Only id and text are read, so other columns can't
clash.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .trie import Trie

#: Words held in a worker's cache before it starts afresh.
CACHE_WORDS = 600_000
#: Below this code point the character classes don't depend on the Unicode version.
SETTLED = 0x300


def byte_alphabet() -> dict[str, int]:
    """The published byte-level alphabet: printable Latin-1 bytes stand for themselves, others for U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _class(*kinds: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(SETTLED) if unicodedata.category(chr(c))[0] in kinds)


SPACE = "\t\n\x0b\x0c\r \x85\xa0"
L, N = _class("L"), _class("N")
#: The published byte-level word pattern, for text below SETTLED.
SETTLED_WORDS = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{SPACE}{L}{N}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
#: A space before a space or the end, where the words of its two sides depend on each other.
LOOSE_SPACE = re.compile(rf" (?:[{SPACE}]|\Z)")
UNSETTLED = re.compile(f"[^\x00-{chr(SETTLED - 1)}]")


def ragged(flat: np.ndarray, sizes: np.ndarray, width: int, fill: int) -> np.ndarray:
    """Rows of the given sizes as a matrix padded with fill."""
    out = np.full((len(sizes), width), fill, flat.dtype)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


class Merges:
    """The merge table of a BPE model as arrays; words are merged many at a time.

    vocab: token as bytes (with any mark of a word's end) -> id; merges: pairs of ids in order of rank.
    """

    NEVER = np.int32(2**31 - 1)

    def __init__(self, pairs: list[tuple[int, int, int]], size: int):
        self.left, self.right, self.rank = np.full(size, -1), np.full(size, -1), np.full(size, -1)
        for r, (a, b, t) in enumerate(pairs):
            if self.rank[t] < 0:
                self.left[t], self.right[t], self.rank[t] = a, b, r
        keys = np.array([(a << 32) | b for a, b, _ in pairs], np.int64)
        made = np.array([t for _, _, t in pairs], np.int32)
        # open addressing: a few vectorised probes beat a binary search
        self.bits = max(4, (4 * len(keys) - 1).bit_length())
        n = 1 << self.bits
        self.keys, self.ranks, self.made = np.full(n, -1, np.int64), np.full(n, self.NEVER, np.int32), np.full(n, -1, np.int32)
        self.probes, todo, at = 0, np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = np.nonzero(self.keys[at] < 0)[0]
            _, one = np.unique(at[free], return_index=True)
            won = free[one]
            self.keys[at[won]], self.ranks[at[won]], self.made[at[won]] = keys[todo[won]], todo[won], made[todo[won]]
            left = np.ones(len(todo), bool)
            left[won] = False
            todo, at = todo[left], (at[left] + 1) & (n - 1)
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Table slots of pairs; a pair that never merges gets a slot of rank NEVER or another key's, so -1."""
        keys = (x.astype(np.int64) << 32) | y.astype(np.int64)
        at = self._slot(keys)
        held = self.keys[at]
        out = np.where(held == keys, at, -1)
        todo = np.nonzero((held != keys) & (held >= 0))[0]
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
            held = self.keys[at[todo]]
            hit = held == keys[todo]
            out[todo[hit]] = at[todo[hit]]
            todo = todo[~hit & (held >= 0)]
        return out

    def rank_of(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.find(x, y)
        return np.where(at < 0, self.NEVER, self.ranks[at]), self.made[at]

    def merge(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of words given as ragged unit ids: the lowest rank first, leftmost on ties."""
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes
        low = 0
        for high in (6, 9, 12, 16, 24, 40, 80, 200, max(201, int(sizes.max(initial=0)))):
            who = np.nonzero((sizes > low) & (sizes <= high))[0]
            low = high
            for i in range(0, len(who), max(1, 400_000 // high)):
                some = who[i : i + max(1, 400_000 // high)]
                n = sizes[some]
                at = np.repeat(starts[some] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                grid, left = self._merge_grid(ragged(flat[at].astype(np.int32), n, int(n.max()), -1), n.copy())
                parts.append((some, left, grid[np.arange(grid.shape[1]) < left[:, None]]))
        if not parts:
            return flat[:0].astype(np.int32), np.zeros(len(sizes), np.int64)
        who = np.concatenate([p[0] for p in parts])
        got = np.zeros(len(sizes), np.int64)
        got[who] = np.concatenate([p[1] for p in parts])
        all_ids, n = np.concatenate([p[2] for p in parts]), got[who]
        begin = np.concatenate([[0], np.cumsum(n)[:-1]])
        order = np.argsort(who)
        n = n[order]
        at = np.repeat(begin[order] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return all_ids[at], got

    def _merge_grid(self, grid: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, width = grid.shape
        if width < 2:
            return grid, n
        ranks = np.full((rows, width), self.NEVER, np.int32)
        made = np.full((rows, width), -1, np.int32)
        real = np.arange(width - 1) < (n - 1)[:, None]
        ranks[:, :-1][real], made[:, :-1][real] = self.rank_of(grid[:, :-1][real], grid[:, 1:][real])
        live, cols = np.arange(rows), np.arange(width)
        while True:
            sub = ranks[live]
            j = sub.argmin(1)
            go = sub[np.arange(len(live)), j] < self.NEVER
            live, j = live[go], j[go]
            if not len(live):
                return grid, n
            t = made[live, j]
            shift = np.minimum(cols + (cols > j[:, None]), width - 1)
            row = np.arange(len(live))[:, None]
            g, r, m = grid[live][row, shift], ranks[live][row, np.minimum(cols + (cols >= j[:, None]), width - 1)], made[live][row, np.minimum(cols + (cols >= j[:, None]), width - 1)]
            at = np.arange(len(live))
            g[at, j] = t
            n[live] -= 1
            r[:, -1], g[:, -1] = self.NEVER, np.where(n[live] < width, -1, g[:, -1])
            k = np.nonzero(j > 0)[0]
            r[k, j[k] - 1], m[k, j[k] - 1] = self.rank_of(g[k, j[k] - 1], t[k])
            last = j + 1 >= n[live]
            r[at[last], j[last]] = self.NEVER
            k = np.nonzero(~last)[0]
            r[k, j[k]], m[k, j[k]] = self.rank_of(t[k], g[k, j[k] + 1])
            grid[live], ranks[live], made[live] = g, r, m


class ByteBPE:
    """Encoder and decoder for one tokenizers file with a byte-level model."""

    def __init__(self, blob: str):
        spec = json.loads(blob)
        alphabet = byte_alphabet()
        vocab = {bytes(alphabet[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes = [b""] * size
        for t, i in vocab.items():
            self.bytes[i] = t
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        pairs = []
        for m in spec["model"]["merges"]:
            a, b = (vocab[bytes(alphabet[c] for c in p)] for p in (m if isinstance(m, list) else m.split(" ")))
            pairs.append((a, b, vocab[self.bytes[a] + self.bytes[b]]))
        self.merges = Merges(pairs, size)
        self.unit = np.array([vocab[bytes([b])] for b in range(256)], np.int32)
        self.trie = Trie(vocab)
        ids = np.arange(size)
        merged = np.nonzero(self.merges.rank >= 0)[0]
        raw = np.frombuffer(b"".join(self.bytes[i] for i in merged), np.uint8)
        got, n = self.merges.merge(self.unit[raw], np.array([len(self.bytes[i]) for i in merged]))
        self.own = np.ones(size, bool)  # whether a token is its own encoding
        self.own[merged[n != 1]] = False
        assert (got[np.repeat(n, n) == 1] == ids[merged[n == 1]]).all()
        self.cache: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.checked = self.merged = 0
        self._library = blob

    # -- words ---------------------------------------------------------------------------------------------

    def words(self, text: str) -> list[str]:
        if not UNSETTLED.search(text):
            return SETTLED_WORDS.findall(text)
        if isinstance(self._library, str):
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self._library)
        alphabet = byte_alphabet()
        pieces = self._library.pre_tokenizer.pre_tokenize_str(text)
        return [bytes(alphabet[c] for c in p).decode() for p, _ in pieces]

    # -- encoding of distinct words ------------------------------------------------------------------------

    def propose(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match for words given as ragged bytes: token ids and the word of each."""
        ends = np.cumsum(sizes)
        at = ends - sizes
        padded = np.append(flat, np.uint8(0))
        live = np.nonzero(sizes > 0)[0]
        node, best, token = (np.zeros(len(sizes), np.int32), at.copy(), np.zeros(len(sizes), np.int32))
        out_token, out_word = [], []
        while len(live):
            p = at[live]
            step = self.trie.step(node[live], padded[p])
            step[p >= ends[live]] = -1
            on = step >= 0
            go, stop = live[on], live[~on]
            node[go] = step[on]
            at[go] += 1
            t = self.trie.ends[step[on]]
            hit = go[t >= 0]
            best[hit], token[hit] = at[hit], t[t >= 0]
            out_token.append(token[stop])
            out_word.append(stop)
            at[stop], node[stop] = best[stop], 0
            live = live[on | (best[live] < ends[live])]
        word = np.concatenate(out_word) if out_word else np.zeros(0, np.int64)
        order = np.argsort(word, kind="stable")
        return (np.concatenate(out_token)[order] if out_token else np.zeros(0, np.int32)), word[order]

    def compatible(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens stays as it is when its bytes are merged alone.

        Undo the merges next to the seam, the latest first. The pair breaks if, at some time, the two tokens at
        the seam could merge before the merge just undone; on equal ranks the seam wins only against the right
        side, as it lies further left.
        """
        x, y = x.astype(np.int64), y.astype(np.int64)
        good = np.ones(len(x), bool)
        live = np.arange(len(x))
        limit = np.full(len(x), Merges.NEVER, np.int64)
        tree = self.merges
        while len(live):
            a, b = x[live], y[live]
            breaks = tree.rank_of(a, b)[0] < limit[live]
            good[live[breaks]] = False
            on_left = tree.rank[a] > tree.rank[b]
            rank = np.maximum(tree.rank[a], tree.rank[b])
            go = ~breaks & (rank >= 0)
            live, a, b, on_left, rank = live[go], a[go], b[go], on_left[go], rank[go]
            x[live] = np.where(on_left, tree.right[a], a)
            y[live] = np.where(on_left, b, tree.left[b])
            limit[live] = np.where(on_left, rank, rank + 1)
        return good

    def learn(self, words: list[str]) -> None:
        """Encode words that the cache lacks."""
        raw = [w.encode() for w in words]
        flat, sizes = np.frombuffer(b"".join(raw), np.uint8), np.array([len(b) for b in raw])
        ids, owner = self.propose(flat, sizes)
        bad = np.zeros(len(words), bool)
        bad[owner[~self.own[ids]]] = True
        inside = owner[1:] == owner[:-1]
        x, y, who = ids[:-1][inside].astype(np.int64), ids[1:][inside], owner[1:][inside]
        pairs, back = np.unique((x << 32) | y, return_inverse=True)
        bad[who[~self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[back]]] = True
        self.checked += len(words)
        self.merged += int(bad.sum())
        again = np.nonzero(bad)[0]
        exact, n = self.merges.merge(self.unit[flat[np.repeat(bad, sizes)]], sizes[again])
        keep = ~bad[owner]
        for some, coded, counts in (
            (np.nonzero(~bad)[0], ids[keep], np.bincount(owner[keep], minlength=len(words))[~bad]),
            (again, exact, n),
        ):
            held = coded.astype("<u4").tobytes()
            stop = (4 * np.cumsum(counts)).tolist()
            self.cache.update(zip([words[i] for i in some.tolist()], [held[a:b] for a, b in zip([0, *stop], stop)]))

    # -- texts ---------------------------------------------------------------------------------------------

    def pieces(self, text: str) -> list[str]:
        """Chunks that no word crosses. A word starts at every space that a visible character follows."""
        if LOOSE_SPACE.search(text):
            return [text]
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.split.split(t) if self.split and any(s in t for s in self.special) else [t] for t in texts]
        parts = [[[p] if i % 2 else self.pieces(p) for i, p in enumerate(c)] for c in cut]
        if len(self.cache) + len(self.chunks) > 2 * CACHE_WORDS:
            self.cache.clear()
            self.chunks.clear()
        new = {x for c in parts for p in c[::2] for x in p}.difference(self.chunks)
        split = {x: self.words(x) for x in new}
        missing = list({w for ws in split.values() for w in ws}.difference(self.cache))
        if missing:
            self.learn(missing)
        word = self.cache.__getitem__
        coded = {x: b"".join(map(word, ws)) for x, ws in split.items() if len(x) > 200}  # not worth keeping
        self.chunks.update((x, b"".join(map(word, ws))) for x, ws in split.items() if len(x) <= 200)
        self.chunks.update(coded)
        get = self.chunks.__getitem__
        out = [
            b"".join(
                np.array([self.special[p[0]]], "<u4").tobytes() if i % 2 else b"".join(map(get, p))
                for i, p in enumerate(c)
            )
            for c in parts
        ]
        for x in coded:
            del self.chunks[x]
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_held: dict[str, ByteBPE] = {}


def load(blob: str) -> ByteBPE:
    key = hashlib.sha256(blob.encode()).hexdigest()
    if key not in _held:
        _held[key] = ByteBPE(blob)
    return _held[key]


def slices(texts: list[str | None], chars: int = 2_000_000) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about so many characters, nulls as empty, with the first one's position."""
    at, held, size = 0, [], 0
    for i, t in enumerate(texts):
        held.append(t or "")
        size += len(held[-1])
        if size >= chars:
            yield at, held
            at, held, size = i + 1, [], 0
    if held:
        yield at, held


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """doc_id with ids (array of int) and decoded (string); with digest, n_tokens, ids_sha256, decoded_sha256 instead.

    vocabulary: path of the tokenizers file, read on the driver.
    """
    spark = docs.sparkSession
    blob = spark.sparkContext.broadcast(Path(vocabulary).read_text())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(blob.value)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for at, part in slices(texts):
                coded = bpe.encode_batch(part)
                decoded = [bpe.decode(c) for c in coded]
                out = {"doc_id": ids.slice(at, len(part))}
                if digest:
                    out |= {
                        "n_tokens": pa.array([len(c) // 4 for c in coded], pa.int64()),
                        "ids_sha256": pa.array([hashlib.sha256(c).hexdigest() for c in coded], pa.string()),
                        "decoded_sha256": pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string()),
                    }
                else:
                    out |= {
                        "ids": pa.array([np.frombuffer(c, "<u4").astype(np.int32) for c in coded], pa.list_(pa.int32())),
                        "decoded": pa.array(decoded, pa.string()),
                    }
                yield pa.RecordBatch.from_pydict(out)

    kind = docs.schema[id_col].dataType.simpleString()
    more = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, {more}")
