import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from gridlab.llm import exact_dedup, simhash, substring_dedup

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_windows(rows, window):
    words = [WORDS.findall(t or "") for _, t, *_ in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (i, *_), w in zip(rows, words):
        gone = {p for a in range(len(w) - window + 1) if seen[tuple(w[a : a + window])] > 1 for p in range(a, a + window)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def got_windows(df):
    return sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in df.collect())


@pytest.mark.parametrize("window", [35, 5])
def test_substring(docs, rows, window):
    assert got_windows(substring_dedup.repeated_words(docs, window, digest=True)) == brute_windows(rows, window)


@pytest.mark.parametrize("share", [1, 10**6])
def test_substring_with_repeats_everywhere(spark, monkeypatch, share):
    """Few different words, so that windows, candidates and whole documents repeat; no key is hot, or every repeated one."""
    monkeypatch.setattr(substring_dedup.common, "HOT_SHARE", share)
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))) for i in range(1, 61)]
    rows += [(100 + i, rows[0][1]) for i in range(5)] + [(None, "a " * 50), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for window in (9, 20):
        got = [(r["doc_id"] or -1, r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.repeated_words(df, window, digest=True).collect()]
        assert sorted(got) == brute_windows([(-1 if i is None else i, t) for i, t in rows], window)


def test_levels_drop_candidates_one_after_the_other(spark, monkeypatch):
    """Pairs of texts share 12, 25 or 40 words; fewer survive each level, and only 40 words are removed."""
    assert substring_dedup.levels(35) == [9, 18, 35]
    rows = []
    for n in (12, 25, 40):
        for k in range(30):
            shared, pair = [f"s{n}x{k}x{i}" for i in range(n)], []
            for side in "pq":
                pair.append(" ".join([f"{side}a{n}x{k}x{i}" for i in range(30)] + shared + [f"{side}z{n}x{k}x{i}" for i in range(30)]))
            rows += [(len(rows) + i, t) for i, t in enumerate(pair)]
    seen = []
    keep = substring_dedup.surviving

    def spy(found, scratch):
        out = keep(found, scratch)
        seen.append({r["at"] // 60 for r in out.collect()} if out is not None else None)
        seen.append(out.select("at").distinct().count() if out is not None else 0)
        return out

    monkeypatch.setattr(substring_dedup, "surviving", spy)
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.repeated_words(df).collect()}
    assert got == {i: 40 if i >= 120 else 0 for i in range(180)}
    assert seen[0] == {0, 1, 2} and seen[2] == {1, 2} and seen[1] > seen[3] > 60
    seen.clear()
    assert all(r["n_removed"] == 0 for r in substring_dedup.repeated_words(df.filter("doc_id < 60")).collect()) and seen[2] is None


def test_substring_carries_columns_of_any_name(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, [1, 2], "x", "lone " * 3, 7), (2, None, "y", "head " + text, 8), (3, [], None, text + " tail", 9)]
    df = spark.createDataFrame(rows, "`doc id` long, `a.b` array<int>, `my col` string, `te xt` string, block int")
    got = substring_dedup.substring_dedup(df, id_col="doc id", text_col="te xt")
    assert got.dtypes == df.dtypes
    assert sorted(tuple(r) for r in got.collect()) == [(1, [1, 2], "x", "lone " * 3, 7), (2, None, "y", "head", 8), (3, [], None, "tail", 9)]


def test_substring_stage(docs, no_docs, rows):
    got = substring_dedup.substring_dedup(docs)
    assert got.columns == docs.columns
    by_id = {r["doc_id"]: r for r in got.collect()}
    assert by_id[13]["text"] == rows[13][1] and by_id[13]["kept"] == "k13"
    assert by_id[8]["text"] == "start end of one" and 10 not in by_id
    assert substring_dedup.substring_dedup(no_docs).count() == 0


def test_leftmost_min():
    v = np.array([3, 1, 1, 2, 0, 5, 0], np.uint64)
    for width in (1, 2, 3, 5):
        assert substring_dedup.leftmost_min(v, width).tolist() == [i + int(v[i : i + width].argmin()) for i in range(len(v) - width + 1)]


def brute_print(text):
    words = WORDS.findall((text or "").translate(AZ))
    if not words:
        return 0
    s = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=2):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_simhash(docs, no_docs, rows):
    got = sorted((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.near_groups(docs).collect())
    ordered = sorted(rows, key=lambda r: r[0])
    prints = [brute_print(r[1]) for r in ordered]
    assert got == [(r[0], p, ordered[c][0]) for r, p, c in zip(ordered, prints, brute_components(prints))]
    assert simhash.near_groups(no_docs).count() == 0
    assert simhash.near_dedup(docs).columns == docs.columns


@pytest.mark.parametrize("radius", [2, 3])
def test_masks_cover_every_pair(radius):
    masks = simhash.masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    for bits in itertools.combinations(range(64), radius):
        assert any(not any(m >> i & 1 for i in bits) for m in masks)


@pytest.mark.parametrize("radius, share", [(2, 1024), (2, 1), (3, 10**6), (4, 10**6)])
def test_components_of_chains(spark, monkeypatch, radius, share):
    """Chains and a hub of fingerprints that differ by up to radius bits, with hot keys and without."""
    from gridlab.llm import common

    monkeypatch.setattr(common, "HOT_SHARE", share)
    rng = random.Random(1)
    prints = {rng.getrandbits(64) for _ in range(30)}
    for k, p in enumerate(list(prints)[:6]):
        for _ in range(12):
            step = sum(1 << b for b in rng.sample(range(64), rng.randint(1, radius + 1)))
            prints.add(p ^ step)
            p = p if k < 2 else p ^ step
    prints = sorted(simhash.signed(p) for p in prints)
    scratch = common.Scratch(spark, "test")
    found = simhash.candidates(spark.createDataFrame([(p,) for p in prints], "fp long"), scratch, radius)
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links(found, radius), scratch).collect()}
    want = brute_components([p % 2**64 for p in prints], radius)
    assert [got.get(p, p) for p in prints] == [prints[c] for c in want]


@pytest.mark.parametrize("k", [1, 2, 1024])
def test_exact(docs, no_docs, rows, k):
    """With one or two counters most digests take the ordinary shuffle, with many all count as frequent."""
    def norm(t):
        return (t or "").translate(AZ)

    size, best = Counter(norm(r[1]) for r in rows), {}
    for r in rows:
        best[norm(r[1])] = max(best.get(norm(r[1]), -1), r[0])
    want = sorted((r[0], best[norm(r[1])], size[norm(r[1])], r[0] == best[norm(r[1])], hashlib.sha256(norm(r[1]).encode()).digest()) for r in rows)
    assert sorted(tuple(x) for x in exact_dedup.exact_groups(docs, k=k).select("doc_id", "keep_id", "group_size", "kept", "digest").collect()) == want
    assert exact_dedup.exact_groups(no_docs).count() == 0
    assert {r["doc_id"] for r in exact_dedup.exact_dedup(docs, k=k).collect()} == set(best.values())


def test_misra_gries():
    rng = random.Random(2)
    items = [b"hot"] * 400 + [b"%d" % rng.randrange(300) for _ in range(600)]
    rng.shuffle(items)
    held = exact_dedup.misra_gries((items[i : i + 50] for i in range(0, 1000, 50)), 20)
    true = Counter(items)
    assert len(held) <= 20 and all(held[d] <= true[d] for d in held) and true[b"hot"] - held[b"hot"] <= 1000 / 21


def stage_rows(df):
    return sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "", r["extra"]) for r in df.collect())


@pytest.mark.parametrize("share", [1024, 10**6])
def test_a_repeated_row_stays_once_through_all_stages(spark, monkeypatch, share):
    from gridlab.llm import common, kneser_ney

    monkeypatch.setattr(common, "HOT_SHARE", share)
    rng = random.Random(9)
    text, other = (" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(50)) for _ in range(2))
    rows = [(1, text, "en", "x")] * 4 + [(2, other, "en", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, extra string").repartition(3)
    labels = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    good = kneser_ney.quality_filter(docs, labels)
    assert good.count() == 5
    assert simhash.near_dedup(good).count() == 2
    got = substring_dedup.substring_dedup(simhash.near_dedup(exact_dedup.exact_dedup(good)))
    assert stage_rows(got) == sorted([(True, 1, text, "x"), (True, 2, other, "y")])


def test_rows_that_share_an_id_do_not_share_a_fate(spark):
    """Of rows with a null id, and of rows with the id 7, one is rejected at each stage; the others stay."""
    from gridlab.llm import kneser_ney

    rng = random.Random(10)
    a, b, c, d, e = (" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(50)) for _ in range(5))
    rows = [(None, a, "en", "x"), (None, b, "en", "x"), (None, "", "en", "x"), (7, c, "en", "x"), (7, None, "en", "x"), (7, d, "en", "x"), (9, e, "en", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, extra string").repartition(3)
    labels = spark.createDataFrame([(9, 1), (7, 1)], "doc_id long, quality int")
    good = [(i is not None, i or 0, t, x) for i, t, _, x in rows if t]
    kept = kneser_ney.quality_filter(docs, labels)
    assert [r for r in stage_rows(kept) if r[0]] == sorted(r for r in good if r[0])
    assert not [r for r in stage_rows(kneser_ney.quality_filter(docs, labels.limit(0))) if not r[2]]
    assert stage_rows(kneser_ney.quality_filter(docs, labels.limit(0))) == sorted(good)
    copies = [(8, a.upper(), "en", "x"), (10, c.upper(), "en", "x")]  # a null id and a 7 lose to them
    more = docs.filter("length(text) > 0").unionByName(spark.createDataFrame(copies, docs.schema))
    left = [(True, 8, a.upper(), "x"), (True, 10, c.upper(), "x")]
    assert stage_rows(exact_dedup.exact_dedup(more)) == sorted([r for r in good if r[2] not in (a, c)] + left)
    near = sorted([r for r in good if r[2] != a] + left[:1])  # the smallest id stays: 8 before null, 7 before 10
    assert stage_rows(simhash.near_dedup(more)) == near
