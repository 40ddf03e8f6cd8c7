import bisect
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from gridlab.llm import bpe, chat, kneser_ney, langid, packing, quality_rules, queries, toxicity

tokenizers = pytest.importorskip("tokenizers")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def odd_texts(n=400):
    rng = random.Random(3)
    signs = [chr(c) for c in range(0x300)] + list(" 　中文字日本のабвΣσ😀́​ \n\t  'sre!!..1234") * 3
    return ["".join(rng.choices(signs, k=rng.randint(0, 40))) for _ in range(n)] + ["don't we're", "  <|endoftext|> ", "<|startoftext|>x", "aaaaaaaaaaaaaaa", ""]


def pack_ids(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_byte_bpe_equals_the_library():
    blob = open(queries.vocabulary("byte_bpe_50k.json")).read()
    own, library, texts = bpe.ByteBPE(blob), tokenizers.Tokenizer.from_str(blob), odd_texts()
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    got = own.encode_batch(texts)
    assert got == [pack_ids(w) for w in want] and own.merged > 0
    assert [own.decode(g) for g in got] == [library.decode(w, skip_special_tokens=False) for w in want]


def test_word_bpe_equals_the_library():
    blob = open(queries.vocabulary("word_bpe_49k.json")).read()
    library, texts = tokenizers.Tokenizer.from_str(blob), odd_texts()
    want = [pack_ids(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert packing.WordBPE(blob).encode_batch(texts) == want


def test_encode(docs, no_docs, rows):
    path = queries.vocabulary("byte_bpe_50k.json")
    got = {r["doc_id"]: r for r in bpe.encode(docs, path).collect()}
    assert len(got) == len(rows) - 1
    for i, text, *_ in rows:
        assert got[i]["decoded"] == (text or "")
    assert bpe.encode(no_docs, path, digest=True).count() == 0


def test_packing(docs, no_docs, rows):
    path = queries.vocabulary("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    got = packing.pack(docs, path, size=64, ids=True).collect()
    seen = Counter((r["doc_id"], r["start"]) for r in got)
    for i, text, *_ in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, packing.END_ID]
        own = sorted({(r["start"], r["length"], tuple(r["ids"]), r["ids_crc32"], r["doc_tokens"]) for r in got if r["doc_id"] == i})
        assert [x for p in own for x in p[2]] == ids
        assert all(c == zlib.crc32(pack_ids(p)) and n == len(p) and t == len(ids) for _, n, p, c, t in own)
        assert {seen[i, p[0]] for p in own} == {sum(r[0] == i for r in rows)}
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["sequence_tokens"]))
    for parts in by_sequence.values():
        end = 0
        for offset, length, total in sorted(parts):
            assert offset == end
            end += length
        assert end == total <= 64
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    assert packing.pack(no_docs, path).count() == 0


def test_histogram_packing():
    rng = random.Random(1)
    for size in (16, 64, 2048):
        for _ in range(40):
            want = {rng.randint(1, size): rng.randint(1, 50) for _ in range(rng.randint(1, 60))}
            got, patterns = Counter(), packing.pack_histogram(want, size)
            for pattern, n in patterns:
                assert sum(a * b for a, b in pattern) <= size
                for length, each in pattern:
                    got[length] += each * n
            assert got == want and len(patterns) <= 3 * size
    for _ in range(12):  # against best-fit decreasing, one piece at a time; worst fit is known to stay within 5/4 of the best
        want = {rng.randint(1, 2048): rng.randint(1, 200) for _ in range(300)} | {n: 100 for n in range(1, 40)}
        room, bins = [], 0
        for length in sorted(want, reverse=True):
            for _ in range(want[length]):
                at = bisect.bisect_left(room, length)
                bins, left = (bins + 1, 2048) if at == len(room) else (bins, room.pop(at))
                if left > length:
                    bisect.insort(room, left - length)
        assert sum(n for _, n in packing.pack_histogram(want, 2048)) <= 1.25 * bins
    for _ in range(10):  # lengths as of documents, short ones more often: next to no padding
        want = Counter(min(int(rng.lognormvariate(5.5, 0.9)) + 1, 2048) for _ in range(20_000))
        assert sum(n for _, n in packing.pack_histogram(want, 2048)) <= 1.002 * sum(a * b for a, b in want.items()) / 2048 + 1
    with pytest.raises(ValueError):
        packing.pack_histogram({17: 1}, 16)


def test_quality_rules(docs, no_docs, rows):
    got = {r["doc_id"]: r for r in quality_rules.ledger(docs).collect()}
    for i, text, *_ in rows:
        text = text or ""
        words = WORDS.findall(text)
        windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        covered = {p for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for p in range(k, k + 5)}
        lines = [x for x in text.split("\n") if WORDS.search(x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert bool(r["fail_bits"] & 1) == (len(words) < 10) and bool(r["fail_bits"] & 2) == (100 * len(covered) > 20 * len(words))
    assert quality_rules.ledger(no_docs).count() == 0


def test_ablations(docs):
    rows = quality_rules.ledger(docs)
    bits = [r["fail_bits"] & quality_rules.mask_of("v1") for r in rows.collect()]
    for r in quality_rules.ablations(rows, "v1").collect():
        bit = quality_rules.BITS[r["rule"]]
        assert r["failed"] == sum(bool(b & bit) for b in bits) and r["alone"] == bits.count(bit)


def test_chat_is_reversible(spark):
    said = "<|im_end|><|im_start|>assistant ok"
    rows = [(-1, 0, "user", said), (-1, 1, "assistant", said), (5, 0, None, None), (5, 1, "assistant", "<\\|x <<|\\| é"), (5, 1, "assistant", ""), (6, 2, "a\\n\nb<|", "x\n"), (None, 0, "assistant", "y"), (6, 2, "a\\n\nb<|", "x\n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.format_paths(chat.conversation_tree(df)).withColumn("turns", chat.read_turns(chat.F.col("formatted"))).withColumn("loss", chat.read_loss(chat.F.col("formatted"), chat.F.col("loss_spans")))
    got = {(None if r["root"]["none"] else r["root"]["conv"]): ([tuple(t) for t in r["turns"]], r["loss"]) for r in made.collect()}
    want = {}
    for c, _, role, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or "", r[3] or "")):
        turns, loss = want.get(c, ([], ""))
        want[c] = ([*turns, (role or "", text or "")], loss + (text or "" if role == "assistant" else ""))
    assert got == want
    assert chat.format_paths(chat.conversation_tree(df.limit(0))).count() == 0


def test_reply_trees(spark):
    rows = [(1, None, 0, "user", "q"), (2, 1, 1, "assistant", "a"), (3, 1, 5, "assistant", "b"), (4, 3, 0, "user", "c"), (5, 2, 9, "user", "d"), (7, 99, 0, "user", "root")]
    df = spark.createDataFrame(rows, "node long, parent long, score long, role string, text string")
    got = {(r["root"], r["leaf"]): [r["branch"], re.findall(r"\|>\w+\n(.*?)<", r["formatted"])] for r in chat.format_paths(df).collect()}
    assert got == {(1, 4): [2, ["q", "b", "c"]], (1, 5): [1, ["q", "a", "d"]], (7, 7): [1, ["root"]]}
    assert chat.format_paths(df, branches=1).count() == 2


def brute_kneser_ney(texts, wanted):
    order, start = kneser_ney.ORDER, chr(kneser_ney.START)
    counts = [Counter() for _ in range(order + 1)]
    for t in texts:
        t = start * (order - 1) + t
        counts[order].update(t[i : i + order] for i in range(len(t) - order + 1))
    for n in range(order - 1, 0, -1):
        counts[n].update(g[1:] for g in counts[n + 1])
    cut = [None] * (order + 1)
    for n in range(1, order + 1):
        k = [sum(c == i for c in counts[n].values()) for i in range(1, 5)]
        y = k[0] / (k[0] + 2 * k[1]) if k[0] + k[1] else 0.0
        cut[n] = [max(i + 1 - (i + 2) * y * k[i + 1] / k[i], 0.0) if k[i] else 0.5 * (i + 1) for i in range(3)]

    def p(g):
        if not g:
            return 1 / kneser_ney.UNITS
        n = len(g)
        own = [c for x, c in counts[n].items() if x[:-1] == g[:-1]]
        if not own:
            return p(g[1:])
        c = counts[n][g]
        spare = sum(cut[n][min(x, 3) - 1] for x in own) / sum(own)
        return (c - (cut[n][min(c, 3) - 1] if c else 0)) / sum(own) + spare * p(g[1:])

    out = []
    for t in wanted:
        t = start * (order - 1) + t
        steps = [math.log(p(t[i : i + order])) for i in range(len(t) - order + 1)]
        out.append(-sum(steps) / len(steps) if steps else None)
    return out


def test_kneser_ney(spark, docs, no_docs, rows):
    texts = ["the cat sat on the mat", "the dog sat on the log", "", "a cat and a dog", "THE!! CAT!!", "zq xj 中"]
    df = spark.createDataFrame([(i, t, "en" if i else None) for i, t in enumerate(texts)] + [(9, None, "xx")], "doc_id long, text string, lang string").repartition(2)
    labels = spark.createDataFrame([(0, 1), (1, 1), (3, 1), (4, 0), (None, 1), (1, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in kneser_ney.classify(df, labels, held=0).collect()}
    want = brute_kneser_ney([texts[0], texts[1], texts[3]], texts)
    for i, w in enumerate(want):
        assert got[i]["nll"] is None if w is None else got[i]["nll"] == pytest.approx(w, abs=1e-9)
    assert not got[2]["kept"] and not got[9]["kept"] and all(got[i]["kept"] for i in (0, 1, 3)) and not got[5]["kept"]
    assert all(r["kept"] == (r["nll"] is not None) for r in kneser_ney.classify(df, labels.limit(0)).collect())
    assert kneser_ney.classify(no_docs, labels).count() == 0
    assert kneser_ney.quality_filter(docs, labels).columns == docs.columns
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("gridlab")]


def test_op8_against_brute_force(spark, tmp_path, monkeypatch):
    """The registered query, held-out split, thresholds by language and verdicts, all computed again in plain Python."""
    monkeypatch.setattr(kneser_ney, "LEAST", 8)
    rng = random.Random(12)
    say = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["schr", "ent", "ung"], "cc": ["xo", "xu"]}
    rows = [(i, " ".join("".join(rng.choices(say[la], k=2)) for _ in range(rng.randint(3, 60))), la) for i, la in enumerate(rng.choices(["aa", "bb", "cc"], [12, 9, 2], k=160))]
    rows += [(200 + i, "".join(rng.choices("qwz#", k=90)), "aa") for i in range(6)] + [(300, rows[0][1], None), (301, "ka", "dd"), (302, "", "aa"), (303, None, None)]
    good = [i for i, _, _ in rows if i < 110]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in good] + [(200, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r for r in queries.op8_quality_classifier(spark, str(tmp_path)).collect()}
    held = {r["doc_id"] for r in spark.range(110).selectExpr("id as doc_id").filter(f"pmod(xxhash64(id), {kneser_ney.HELD}) = 0").collect()}
    nll = dict(zip([r[0] for r in rows], brute_kneser_ney([t for i, t, _ in rows if i in good and i not in held], [t or "" for _, t, _ in rows])))

    def quantile(values, q):
        return sorted(values)[max(math.ceil(q * len(values)) - 1, 0)]

    unseen = [(i, t, la) for i, t, la in rows if i in held]
    middle = {la: quantile([nll[i] for i, _, x in unseen if x == la], 0.5) for la in {x for _, _, x in unseen}}
    far = {la: [(nll[i] - middle[la]) * math.sqrt(len(t)) for i, t, x in unseen if x == la] for la in middle}
    every = quantile([nll[i] for i, _, _ in unseen], 0.5)
    over_all = quantile([(nll[i] - every) * math.sqrt(len(t)) for i, t, _ in unseen], kneser_ney.QUANTILE)
    pooled = quantile([x for some in far.values() for x in some], kneser_ney.QUANTILE)
    assert any(len(x) < 8 for x in far.values()) and any(len(x) >= 8 for x in far.values())
    for i, t, la in rows:
        r = got[i]
        assert (r["trusted"], r["held"]) == (i in good, i in held)
        if not t:
            assert r["nll"] is None and not r["kept"]
            continue
        spread = over_all if la not in middle else quantile(far[la], kneser_ney.QUANTILE) if len(far[la]) >= 8 else pooled
        limit = middle.get(la, every) + spread / math.sqrt(len(t))
        assert r["nll"] == pytest.approx(nll[i], abs=1e-9) and r["threshold"] == pytest.approx(limit, abs=1e-9) and r["kept"] == (nll[i] <= limit + 1e-9)
    assert len(got) == len(rows) and not any(got[200 + i]["kept"] for i in range(6))


def test_language(spark, docs, no_docs):
    rng = random.Random(0)
    parts = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["schr", "ent", "ung", "ber"]}
    rows = [(i, " ".join("".join(rng.choices(parts[la], k=3)) for _ in range(30)), la) for i, la in enumerate(rng.choices(["aa", "bb"], k=120))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    path = queries.vocabulary("byte_bpe_multi_50k.tiktoken")
    model = langid.train(df.filter(langid.in_training(langid.F.col("doc_id"))), path)
    got = {r["doc_id"]: r for r in langid.predict(df, path, model).collect()}
    assert sum(got[i]["lang_pred"] == la for i, _, la in rows) == len(rows) and all(0 <= r["score"] <= 1 for r in got.values())
    odd = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, path, model).collect()}
    assert odd[0] == odd[1] == odd[2] == "und" and odd[3] != "und"
    assert langid.predict(no_docs, path, model).count() == 0
    none = langid.train(df.limit(0), path)
    assert {r["lang_pred"] for r in langid.predict(df, path, none).collect()} == {"und"}


def test_forward_sums_all_segmentations():
    pieces = [b" ", b"a", b"b", b"ab", b" a", b"ba"]
    prob = np.array([[0.2], [0.3], [0.1], [0.2], [0.1], [0.1]])
    lattice = langid.Lattice(pieces)
    got = np.exp(langid.log_likelihood(lattice, ["ab", "aba"], prob))[:, 0]
    s = dict(zip(pieces, prob[:, 0]))

    def total(b):
        return 1.0 if not b else sum(s[b[:n]] * total(b[n:]) for n in range(1, len(b) + 1) if b[:n] in s)

    assert got.tolist() == pytest.approx([total(b" ab"), total(b" aba")])


def test_toxicity(spark, docs, no_docs):
    rng = random.Random(0)
    bad = ["grumblock", "snarfish", "vexolian"]
    rows = []
    for i in range(500):
        words, toxic = [f"w{rng.randrange(300)}" for _ in range(40)], rng.random() < 0.2
        if toxic:
            for w in rng.sample(bad, 2):
                words[rng.randrange(40)] = w + rng.choice(["", "s"])
        rows.append((i, " ".join(words), int(toxic)))
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(df, labels.filter(langid.in_training(langid.F.col("doc_id"))))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    wrong = [i for i, _, y in rows if (got[i] >= toxicity.THRESHOLD) != bool(y)]
    assert len(wrong) <= 5
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(docs, model).collect())
    assert toxicity.score(no_docs, model).count() == 0
    plain = toxicity.train(df.limit(0), labels.limit(0))
    insult = spark.createDataFrame([(1, "you idiot"), (2, "fine day")], "doc_id long, text string")
    assert [r["score"] >= toxicity.THRESHOLD for r in toxicity.score(insult, plain).orderBy("doc_id").collect()] == [True, False]




def test_toxicity_mines_the_vocabulary_of_few_texts():
    """Eight of 408 toxic texts are of a rare language with insults of its own; a text copied nine times adds no words."""
    rng = random.Random(5)

    def text(language, *extra):
        words = [f"{language}{''.join(rng.choices('aeiou', k=4))}" for _ in range(30)] + list(extra)
        return " ".join(rng.sample(words, len(words)))

    toxic = [text("k", "grumblock") for _ in range(400)] + [text("z", "snarfish" + rng.choice("ax")) for _ in range(8)]
    toxic += [toxic[0] + " plainword"] * 9
    other = [text("k") for _ in range(1500)] + [text("z") for _ in range(60)]
    mined = toxicity.mine(toxic + other, [True] * len(toxic) + [False] * len(other))
    assert any("snarfish".startswith(e[2:6]) for e in mined) and any("grumblock".startswith(e[2:6]) for e in mined)
    assert not any("plainword".startswith(e[2:6]) for e in mined)


def test_quality_threshold_follows_the_scatter_of_sizes(spark, monkeypatch):
    """A long text that is far out among long ones goes, though a short one of the same score may stay."""
    rng = random.Random(6)
    rows = [(i, "en", n, 1.6 + rng.gauss(0, 0.8) / math.sqrt(n), True) for i in range(400) for n in [rng.choice([25, 400, 2500])]]
    rows += [(1000, "en", 25, 1.75, False), (1001, "en", 2500, 1.75, False), (1002, None, 2500, 1.75, False), (1003, "en", 2500, 1.63, False)]
    df = spark.createDataFrame([(*r, r[0] % 2 == 0 and r[4]) for r in rows], "doc_id long, lang string, n_units long, nll double, trusted boolean, held boolean")
    monkeypatch.setattr(kneser_ney, "scores", lambda *a: df)
    kept = {r["doc_id"]: r["kept"] for r in kneser_ney.classify(None, None).collect()}
    assert [kept[i] for i in (1000, 1001, 1002, 1003)] == [True, False, False, True]
    assert sum(kept[i] for i in range(400)) >= 395


def test_reply_trees_refuse_cycles_and_repeated_nodes(spark):
    schema = "node long, parent long, score long, role string, text string"
    for edges in ([(1, 1)], [(1, 2), (2, 1)], [(1, 3), (2, 1), (3, 2), (4, 3), (5, 4)]):
        with pytest.raises(ValueError, match="cycle"):
            chat.format_paths(spark.createDataFrame([(n, p, 0, "user", "x") for n, p in edges], schema))
    with pytest.raises(Exception, match="several rows"):
        chat.format_paths(spark.createDataFrame([(1, None, 0, "user", "x"), (1, None, 0, "user", "y")], schema)).collect()
    deep = [(i, i - 1 if i else None, i, "user", f"t{i}") for i in range(21)] + [(100, 10, 99, "user", "side")]
    got = {r["leaf"]: (r["branch"], re.findall(r"\|>\w+\n(.*?)<", r["formatted"])) for r in chat.format_paths(spark.createDataFrame(deep, schema)).collect()}
    assert got == {20: (1, [f"t{i}" for i in range(21)]), 100: (2, [f"t{i}" for i in range(11)] + ["side"])}


@pytest.mark.parametrize("fan", [4096, 3])
def test_ranks_by_levels_of_prefix_sums(spark, monkeypatch, fan):
    """One length holds most pieces, repeated rows among them; ranks of each length run from 0 without a gap."""
    from gridlab.llm.common import Scratch

    monkeypatch.setattr(packing, "SALT_ROWS", 4)
    monkeypatch.setattr(packing, "FAN", fan)
    rows = [(i, 2048 if i % 5 else i % 3, "same") for i in range(500)]
    df = spark.createDataFrame(rows, "piece long, length long, other string")
    got = packing.ranked(df, "length", "piece", len(rows), Scratch(spark, "test")).collect()
    by = {}
    for r in got:
        by.setdefault(r["length"], []).append(r["rank"])
    assert len(got) == 500 and all(sorted(x) == list(range(len(x))) for x in by.values())


def test_label_model_finds_accuracies_and_correlations():
    """Seven voters of known rates; voters 4, 5 and 6 mostly repeat voter 3, a weak one."""
    rng = np.random.default_rng(8)
    n, true = 20_000, np.array([[0.8, 0.7, 0.75, 0.6], [0.05, 0.1, 0.08, 0.4]])
    y = rng.random(n) < 0.2
    votes = (rng.random((n, 4)) < np.where(y[:, None], true[0], true[1])).astype(float)
    tied = [np.where(rng.random(n) < 0.9, votes[:, 3], rng.random(n) < 0.5) for _ in range(3)]
    votes = np.column_stack([votes, *tied])
    post, fire, parent = toxicity.label_model(votes, 3, 0.2)
    assert all(parent[i] < 0 for i in (0, 1, 2)) and (parent[3:] >= 0).sum() == 3  # a tree over 3 to 6, nothing else
    for c in (0, 1):
        assert np.abs(fire[c, 0, :3] - true[c, :3]).max() < 0.03
    child = next(i for i in range(3, 7) if parent[i] >= 0)
    assert abs(fire[0, 1, child] - fire[0, 0, child]) > 0.7  # the vote of the parent decides, whatever the class
    # the exact posterior: what repeats voter 3 adds nothing
    says = np.where(votes[:, :4] > 0, np.log(true[0] / true[1]), np.log((1 - true[0]) / (1 - true[1]))).sum(1)
    best = 1 / (1 + np.exp(-(says + math.log(0.2 / 0.8))))
    assert np.abs(post - best).mean() < 0.01
    plain = np.concatenate([true, np.tile(true[:, 3:], 3)], axis=1)
    naive = np.where(votes > 0, np.log(plain[0] / plain[1]), np.log((1 - plain[0]) / (1 - plain[1]))).sum(1)
    assert np.abs(1 / (1 + np.exp(-(naive + math.log(0.2 / 0.8)))) - best).mean() > 3 * np.abs(post - best).mean()


def test_long_words_are_summed_whole():
    """Words of 11 to 60 letters and one of 3000, against exact sums, whatever the blocks."""
    from fractions import Fraction

    rng = random.Random(3)
    pieces = sorted({"".join(rng.choices("abé", k=rng.randint(1, 12))).encode() for _ in range(300)} | {b" ", b"a", b"b", b" a", b"\xc3", b"\xa9"})
    prob = np.random.default_rng(1).dirichlet(np.full(len(pieces), 0.3), 2).T
    prob = (prob + 1e-7) / (prob + 1e-7).sum(0)
    words = ["".join(rng.choices("abé", k=k)) for k in [*range(11, 61), 3000, 1, 2]]
    got = langid.log_likelihood(langid.Lattice(pieces), words, prob)
    for w, row in zip(words, got):
        raw = b" " + w.encode()
        for la in (0, 1):
            table = {p: Fraction(float(x)) if len(raw) < 200 else float(x) for p, x in zip(pieces, prob[:, la])}
            total, log = [1], 0.0  # of the bytes so far; long words in floats with a running scale
            for j in range(1, len(raw) + 1):
                total.append(sum((total[i] * table[raw[i:j]] for i in range(max(0, j - 24), j) if raw[i:j] in table), 0))
                if len(raw) >= 200 and j % 20 == 0:
                    top = max(total[-25:])
                    total[-25:], log = [x / top for x in total[-25:]], log + math.log(top)
            want = math.log(float(total[-1] * 10**200)) - 200 * math.log(10) if len(raw) < 200 else math.log(total[-1]) + log
            assert row[la] == pytest.approx(want, rel=1e-9)


def test_expected_counts_by_enumeration():
    pieces = [b" ", b"a", b"b", b"ab", b" a", b"ba", b"aba"]
    prob = np.array([[0.2, 0.1], [0.2, 0.2], [0.1, 0.2], [0.2, 0.1], [0.1, 0.1], [0.1, 0.2], [0.1, 0.1]])
    words, weight = ["ab", "aba", "b" + "ab" * 20], np.array([[2.0, 0.0], [1.0, 3.0], [0.0, 1.0]])

    def ways(b):
        return [[]] if not b else [[i, *rest] for i, p in enumerate(pieces) if b.startswith(p) for rest in ways(b[len(p) :])]

    got = langid.expected_counts(langid.Lattice(pieces), words, weight, prob)
    want = np.zeros(prob.shape)
    for w, n in zip(words[:2], weight[:2]):
        for la in (0, 1):
            found = [(np.prod(prob[x, la]), x) for x in ways(b" " + w.encode())]
            for p, x in found:
                np.add.at(want[:, la], x, n[la] * p / sum(q for q, _ in found))
    long = langid.expected_counts(langid.Lattice(pieces), words[2:], weight[2:], prob)
    assert got - long == pytest.approx(want) and (long * np.array([len(p) for p in pieces])[:, None]).sum(0) == pytest.approx([0, 42])


def test_letters_are_of_category_l(spark):
    path = queries.vocabulary("byte_bpe_multi_50k.tiktoken")
    rows = [(i, t, la) for i, (t, la) in enumerate([("½ ² ⅷ ① 12_", None), ("schrumpfungen", "de"), ("the cat", "en")] * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(df, path, langid.train(df, path)).collect()}
    assert got[0] == ("und", 0.0) and got[1][0] == "de" and got[2][0] == "en"
    assert langid.words_of("x½y ÉTÉ a_b 中文1") == ["x", "y", "été", "a", "b", "中文"]
