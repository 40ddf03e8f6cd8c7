"""Quality rules as a bitmask ledger, DataFrame functions only.

Every rule is evaluated once per document; the ledger keeps the measurements and one failure bit a rule.
Policies are versioned sets of rules, applied later as one bitwise AND, and ablations (what would come back if
a rule were dropped) are sums over the same bits.

Defined cases: a null text has no words and no lines; an empty text likewise; a text without words fails
`few_words`; repeated rows are judged alike; an empty table gives an empty ledger. The ledger has its own
columns and only id and text are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
#: Words of a window of `n_repeat_words`.
SPAN = 5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, however often the body, or a lambda in it, uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+`, in order."""
    inner = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", "")
    return let(inner, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"[\x20\x09-\x0D]+", -1)))


def repeat_words(words: Column) -> Column:
    """Words covered by SPAN-word windows that the text holds twice or more, the first included."""
    n = F.size(words)

    def keyed(hashes: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), n - SPAN), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(SPAN)])
        )

    def covered(windows: Column) -> Column:
        def starts(order: Column) -> Column:
            same = lambda i, j: F.get(order, i)["h"].eqNullSafe(F.get(order, j)["h"])
            return F.sort_array(
                F.transform(
                    F.filter(
                        F.sequence(F.lit(0), F.size(order) - 1),
                        lambda i: ((i > 0) & same(i, i - 1)) | ((i < F.size(order) - 1) & same(i, i + 1)),
                    ),
                    lambda i: F.get(order, i)["p"],
                )
            )

        def total(at: Column) -> Column:
            steps = F.transform(at, lambda p, i: F.least(F.coalesce(F.get(at, i + 1) - p, F.lit(SPAN)), F.lit(SPAN)))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        order = F.sort_array(F.transform(windows, lambda h, p: F.struct(h.alias("h"), p.alias("p"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(
            let(order, lambda o: let(starts(o), total))
        )

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(n <= SPAN, 0).otherwise(let(hashes, lambda h: let(keyed(h), covered))).cast("long")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the measurements: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(NOT_SPACE))
    line_counts = let(
        lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))
    )
    word_counts = let(
        words_of(text),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words")),
    )
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        word_counts.alias("w"),
        line_counts.alias("l"),
    ).select(
        "doc_id",
        "w.n_words",
        "word_chars",
        "n_symbols",
        F.col("l.n").cast("long").alias("n_lines"),
        F.col("l.dup").cast("long").alias("n_dup_lines"),
        "w.n_repeat_words",
    )


#: name -> whether a document fails; the position is the rule's bit and never changes once published.
RULES: dict[str, Callable[[], Column]] = {
    "few_words": lambda: F.col("n_words") < 10,
    "repeated_windows": lambda: 100 * F.col("n_repeat_words") > 20 * F.col("n_words"),
    "symbols": lambda: 100 * F.col("n_symbols") > 10 * F.col("word_chars"),
    "duplicate_lines": lambda: (10 * F.col("n_dup_lines") > 3 * F.col("n_lines")),
    "long_words": lambda: F.col("word_chars") > 20 * F.col("n_words"),
    "short_words": lambda: F.col("word_chars") < 2 * F.col("n_words"),
}
BITS = {name: 1 << i for i, name in enumerate(RULES)}
BASE = ("few_words", "repeated_windows")
#: Policy versions: the rules a document must not fail.
POLICIES: dict[str, tuple[str, ...]] = {"base": BASE, "v1": (*BASE, "symbols", "duplicate_lines"), "v2": tuple(RULES)}


def mask_of(policy: str) -> int:
    return sum(BITS[r] for r in POLICIES[policy])


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements plus fail_bits, one bit a rule."""
    bits = F.lit(0).cast("long")
    for name, failed in RULES.items():
        bits = bits + F.when(failed(), F.lit(BITS[name])).otherwise(0)
    return measure(docs, id_col, text_col).withColumn("fail_bits", bits)


def verdict(policy: str) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask_of(policy))) == 0


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """One row per rule of a policy: failed (documents), alone (documents only this rule rejects).

    The ledger is first summed by bit pattern, at most 2 ** len(RULES) rows.
    """
    mask = mask_of(policy)
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BITS[r]).cast("long").alias("bit")) for r in POLICIES[policy]]))
    return (
        patterns.select("bits", "n", rules.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("alone"),
        )
    )
