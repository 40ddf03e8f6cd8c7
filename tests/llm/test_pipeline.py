"""The registered queries and the pipeline on small tables, against plain Python."""

import hashlib
import math
import random
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from test_dedup import AZ, brute_components, brute_print, brute_windows
from test_text import brute_kneser_ney, pack_ids

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from gridlab.llm import kneser_ney, langid, packing, queries, toxicity  # noqa: E402
from gridlab.llm.common import row_key  # noqa: E402

tokenizers = pytest.importorskip("tokenizers")
SAY = {"en": ["ka", "lo", "mi", "tu", "re"], "de": ["schr", "ent", "ung", "ber"]}
BAD = ["idiot", "moron", "grumblock"]


def corpus():
    """Rows (doc_id, text, lang, source, n_chars, toxic): both languages, junk, repeated rows, copies, near copies, passages, nulls."""
    rng = random.Random(21)

    def text(la, n):
        return " ".join("".join(rng.choices(SAY[la], k=rng.randint(2, 4))) for _ in range(n))

    plain = [(text(la, rng.randint(5, 90)), la) for la in rng.choices(["en", "de"], k=90)]
    passage = text("en", 60)
    plain += [(text("en", 20) + " " + passage + " " + text("en", 20), "en"), (text("en", 9) + " " + passage, "en"), (passage, "en")]
    long = text("en", 2500)
    words = long.split()
    words[1200] = "kalomi"
    plain += [(long, "en"), (" ".join(words), "en"), (plain[3][0].upper(), plain[3][1]), (plain[4][0], plain[4][1]), ("#$%& " * 50, "en"), ("qwx qwz " * 30, "de"), ("", "en"), (None, None), ("  \n", None)]
    insulted = [(f"{t} {rng.choice(BAD)} {rng.choice(BAD)}", la) for t, la in ((text(la, 25), la) for la in rng.choices(["en", "de"], k=40))]
    rows = [(i, t, la, "s", len(t or "")) for i, (t, la) in enumerate(plain + insulted)]
    rows += [rows[5], rows[5], (None, text("de", 40), "de", "s", 1), (None, rows[7][1], "de", None, None)]
    return rows, len(plain)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows, n_plain = corpus()
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(r[0], 1 if r[0] < 90 else None, int(r[0] >= n_plain)) for r in rows if r[0] is not None and r[0] < 160]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return rows, labels, str(path)


def quantile(values, q):
    return sorted(values)[max(math.ceil(q * len(values)) - 1, 0)]


def plain_quality(rows, trusted, held):
    """Rows that the classifier keeps; trusted and held are sets of positions."""
    nll = brute_kneser_ney([rows[i][1] for i in sorted(trusted - held)], [r[1] or "" for r in rows])
    far = lambda i, m: (nll[i] - m) * math.sqrt(len(rows[i][1]))
    middle = {la: quantile([nll[i] for i in held if rows[i][2] == la], 0.5) for la in {rows[i][2] for i in held}}
    every = quantile([nll[i] for i in held], 0.5)
    over_all = quantile([far(i, every) for i in held], kneser_ney.QUANTILE)
    pooled = quantile([far(i, middle[rows[i][2]]) for i in held], kneser_ney.QUANTILE)
    out = []
    for i, r in enumerate(rows):
        if not r[1]:
            continue
        own = [far(j, middle[r[2]]) for j in held if rows[j][2] == r[2]] if r[2] in middle else []
        spread = over_all if not own else quantile(own, kneser_ney.QUANTILE) if len(own) >= kneser_ney.LEAST else pooled
        if nll[i] <= middle.get(r[2], every) + spread / math.sqrt(len(r[1])) + 1e-9:
            out.append(r)
    return out


def one_a_group(rows, group, best):
    """Of rows with one group the best by id; of repeated rows one."""
    chosen = {}
    for g, r in zip(group, rows):
        if g not in chosen or best(r, chosen[g]):
            chosen[g] = r
    return list(chosen.values())


def test_pipeline(spark, tables):
    rows, labels, sf_dir = tables
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = {i for i, q, _ in labels if q == 1}
    marked = docs.withColumn("key", row_key("doc_id", "text", "lang")).selectExpr("doc_id", "text", "lang", f"pmod(xxhash64(key), {kneser_ney.HELD}) = 0 as held").collect()
    held_keys = {(r["doc_id"], r["text"], r["lang"]) for r in marked if r["held"]}
    trusted = {i for i, r in enumerate(rows) if r[0] in good and r[1]}
    want = plain_quality(rows, trusted, {i for i in trusted if rows[i][:3] in held_keys})
    assert 0 < len(rows) - len(want) < 60
    want = one_a_group(want, [r[1].translate(AZ) for r in want], lambda a, b: (a[0] is not None, a[0] or 0) > (b[0] is not None, b[0] or 0))
    kept_exact = len(want)
    want.sort(key=lambda r: (r[0] is None, r[0] or 0))
    want = one_a_group(want, brute_components([brute_print(r[1]) for r in want], corpus_pipeline.NEAR_RADIUS), lambda a, b: False)
    assert len(want) < kept_exact  # the near copies
    cut = []
    indexed = [(i, r[1]) for i, r in enumerate(want)]
    counts = Counter(tuple(w[a : a + 35]) for _, t in indexed for w in [t.split()] for a in range(len(w) - 34))
    for i, t in indexed:
        w = t.split()
        gone = {p for a in range(len(w) - 34) if counts[tuple(w[a : a + 35])] > 1 for p in range(a, a + 35)}
        if len(gone) < len(w) or not w:
            cut.append((want[i][0], " ".join(x for p, x in enumerate(w) if p not in gone) if gone else t))
    assert len(cut) < len(want) and cut != [(r[0], r[1]) for r in want]
    library = tokenizers.Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    pieces = []
    for i, t in cut:
        ids = [*library.encode(t, add_special_tokens=False).ids, packing.END_ID]
        pieces += [(i, a, len(ids[a : a + 2048]), zlib.crc32(pack_ids(ids[a : a + 2048])), len(ids)) for a in range(0, len(ids), 2048)]
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got), key=lambda r: (r[0] is None, r[0] or 0, r[1:])) == sorted(pieces, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))
    ends = {}
    for s, o, n in sorted((r["sequence_id"], r["offset"], r["length"]) for r in got):
        assert ends.get(s, 0) == o
        ends[s] = o + n
    assert all(n <= 2048 for n in ends.values()) and len(ends) <= sum(p[2] for p in pieces) / 2048 + 2


def test_stages_keep_the_columns_and_stand_empty_tables(spark, tables):
    _, _, sf_dir = tables
    none = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, none, sf_dir)
        assert got.count() == 0 and (name == "packing" or got.columns == none.columns)


def test_op1_op2_op10(spark, tables):
    rows, _, sf_dir = tables
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in queries.op1_substring_dedup(spark, sf_dir).collect()]
    want = [(rows[i][0], *rest) for i, *rest in brute_windows([(i, r[1]) for i, r in enumerate(rows)], 35)]
    assert sorted(got, key=key) == sorted(want, key=key)
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    prints = [brute_print(r[1]) for r in order]
    want = [(r[0], f"{p:016x}", order[c][0]) for r, p, c in zip(order, prints, brute_components(prints))]
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in queries.op2_simhash_near_dedup(spark, sf_dir).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    texts = [(r[1] or "").translate(AZ) for r in rows]
    best = {t: max((r[0] for r, x in zip(rows, texts) if x == t and r[0] is not None), default=None) for t in texts}
    want = [(r[0], hashlib.sha256(t.encode()).hexdigest(), texts.count(t), best[t], r[0] == best[t]) for r, t in zip(rows, texts)]
    got = [(r["doc_id"], r["text_sha256"], r["group_size"], r["keep_id"], r["kept"]) for r in queries.op10_exact_dedup(spark, sf_dir).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_op3_op7(spark, tables):
    rows, _, sf_dir = tables
    library = tokenizers.Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        said = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(pack_ids(ids)).hexdigest(), hashlib.sha256(said.encode()).hexdigest()))
    got = [(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op3_bpe(spark, sf_dir).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    library = tokenizers.Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    sizes = [(i, len(library.encode(t or "", add_special_tokens=False).ids) + 1) for i, t, *_ in rows]
    got = queries.op7_packing(spark, sf_dir).collect()
    assert sorted((str(r["doc_id"]), r["doc_tokens"]) for r in got if not r["start"]) == sorted((str(i), n) for i, n in sizes)
    assert sum(r["length"] for r in got) == sum(n for _, n in sizes)


def training(rows):
    return [r for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 != 1]


def test_op4(spark, tables):
    """Held-out rows get their language; scores equal those of a plain model of the training rows."""
    rows, _, sf_dir = tables
    pieces = langid.read_pieces(queries.vocabulary("byte_bpe_multi_50k.tiktoken"))
    counts = {}
    for _, t, la, *_ in training(rows):
        if la and t is not None:
            counts.setdefault(la, Counter()).update(langid.words_of(t))
    scorer = langid.Scorer(pieces, *langid.fit(counts, pieces))
    want = {(r[0], r[1]): s for r, s in zip(rows, scorer.score([r[1] or "" for r in rows]))}
    texts = {}
    for r in rows:
        texts.setdefault(r[0], set()).add(r[1])
    got = queries.op4_language_id(spark, sf_dir).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert any(want[r["doc_id"], t][0] == r["lang_pred"] and want[r["doc_id"], t][1] == pytest.approx(r["score"], abs=1e-6) for t in texts[r["doc_id"]])
    spoken = {r[0]: r[2] for r in rows if r[0] is not None and r[0] < 90}
    assert all(r["lang_pred"] == spoken[r["doc_id"]] for r in got if r["doc_id"] in spoken)


def test_op5(spark, tables):
    """The query's scores equal those of a model fitted in plain Python on the training rows, and find held-out texts."""
    rows, labels, sf_dir = tables
    marks = {i: y for i, _, y in labels}
    both = sorted((r[1] or "", marks[r[0]]) for r in training(rows) if r[0] in marks)
    model = toxicity.fit([t for t, _ in both], [y == 1 for _, y in both])
    voters, coef = toxicity.Voters(model["entries"]), np.array(model["coef"])
    got = queries.op5_toxicity(spark, sf_dir).collect()
    texts = {}
    for r in rows:
        texts.setdefault(r[0], set()).add(r[1])
    for r in got:
        plain = [1 / (1 + math.exp(-(voters.look(t or "") @ coef[:-1] + coef[-1]))) for t in texts[r["doc_id"]]]
        assert any(p == pytest.approx(r["score"], abs=1e-6) for p in plain) and r["predicted"] == (r["score"] >= 0.7)
    held = [(r["predicted"], marks[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in marks]
    assert sum(p for p, y in held if y) >= 0.9 * sum(y for _, y in held) and not any(p for p, y in held if not y)


def test_op6_op9_run_on_tables(spark, tables, tmp_path):
    rows, _, sf_dir = tables
    got = queries.op9_quality_rules(spark, sf_dir).collect()
    assert len(got) == len(rows) and all(r["base_failed"] <= (not r["kept"]) for r in got)
    talk = [(1, 0, "user", "a <|im_end|>"), (1, 1, "assistant", "b\nc"), (2, 0, "assistant", None)]
    spark.createDataFrame(talk, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    said = {r["conv_id"]: r for r in queries.op6_chat_formatting(spark, str(tmp_path)).collect()}
    assert set(said) == {-1, 1, 2} and said[1]["loss_sha256"] == hashlib.sha256(b"b\nc").hexdigest() and said[2]["n_turns"] == 1
    probe = "<|im_end|><|im_start|>assistant ok"
    turns = f"user\n{probe}\nassistant\n{probe}\n"
    assert said[-1]["turns_sha256"] == hashlib.sha256(turns.encode()).hexdigest() and said[-1]["loss_chars"] == len(probe)
