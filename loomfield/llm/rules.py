"""Quality rules kept in a bitmask ledger (DataFrame functions only).

Every rule is evaluated once per document. The ledger stores its measurements and one bit per
failed rule; policies are masks over those bits, so another policy, or an ablation of one, is
bitwise arithmetic on the ledger and never reads a text again.

Definitions: a null text has no words, a document without words fails ``few_words``; rows with
the same doc_id are judged one by one; extra columns are ignored; an empty table gives an empty
ledger.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"

#: name -> condition over the measurements; the bit is the place in this dict
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 10 * n_words",
    "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 20 * n_words",
    "shouting": "100 * n_upper > 40 * word_chars",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_words"]
#: versioned policies: the rules whose failure rejects a document
POLICIES: dict[str, int] = {"base": BASE, "v1": BASE | BIT["symbols"] | BIT["repeated_lines"] | BIT["word_length"], "v2": sum(BIT.values())}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once (a lambda would compute it per element)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column, width: int) -> Column:
    """Words covered by a ``width``-word window that is found twice or more among ``words``.

    The windows' hashes are sorted with their places, so the cost is n log n in a long text.
    """

    def windows(w: Column) -> Column:
        places = F.when(F.size(w) >= width, F.sequence(F.lit(0), F.size(w) - width)).otherwise(F.array().cast("array<int>"))
        return F.sort_array(F.transform(places, lambda i: F.struct(F.xxhash64(*[F.get(w, i + k) for k in range(width)]).alias("h"), i.alias("i"))))

    def found_again(s: Column) -> Column:
        same = lambda x, i: x["h"] == F.get(s, i)["h"]
        return F.filter(s, lambda x, i: F.coalesce(same(x, i - 1), F.lit(False)) | F.coalesce(same(x, i + 1), F.lit(False)))

    def covered(s: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        step = lambda a, p: F.struct((a["n"] + p + width - F.greatest(a["end"], p)).alias("n"), (p + width).alias("end"))
        return F.aggregate(F.sort_array(F.transform(found_again(s), lambda x: x["i"])), start, step, lambda a: a["n"])

    return let(words, lambda w: let(windows(w), covered))


def measure(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The measurements that rules look at; one narrow pass, no shuffle."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    long = lambda c: c.cast("long")
    split = docs.select(*keep, t.alias("_t"), F.array_remove(F.split(t, SPACE + "+"), "").alias("_w"), lines.alias("_l"))
    return split.select(
        *keep,
        long(F.size("_w")).alias("n_words"),
        long(F.length("_t") - F.regexp_count("_t", F.lit(SPACE))).alias("word_chars"),
        long(F.regexp_count("_t", F.lit(SYMBOL))).alias("n_symbols"),
        long(F.size("_l")).alias("n_lines"),
        long(F.size("_l") - F.size(F.array_distinct("_l"))).alias("n_dup_lines"),
        long(F.regexp_count("_t", F.lit("[A-Z]"))).alias("n_upper"),
        long(_repeat_words(F.col("_w"), 3)).alias("n_repeat_words"),
    )


def ledger(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Measurements and ``fail_bits`` of every document."""
    bits = [F.when(F.expr(rule), F.lit(BIT[name])).otherwise(F.lit(0)) for name, rule in RULES.items()]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measure(docs, text, keep).withColumn("fail_bits", total.cast("long"))


def apply_policy(rows: DataFrame, policy: str | int = "v2", name: str = "kept") -> DataFrame:
    """``name``: none of the policy's bits is set."""
    mask = POLICIES[policy] if isinstance(policy, str) else policy
    return rows.withColumn(name, F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")) == 0)


def ablate(rows: DataFrame, policy: str | int = "v2") -> DataFrame:
    """Per rule of a policy: documents failing it, failing it alone, and kept if it were left out.

    The ledger collapses to one row per bit pattern first (at most 2 ** rules rows).
    """
    mask = POLICIES[policy] if isinstance(policy, str) else policy
    hit = F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long"))
    patterns = rows.groupBy(hit.alias("hit")).agg(F.count(F.lit(1)).alias("n"))
    rule = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(b).cast("long").alias("bit")) for r, b in BIT.items() if b & mask]))
    each = patterns.select("hit", "n", rule.alias("r")).select("hit", "n", "r.*")
    failed = F.col("hit").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule", "bit").agg(
        F.sum(F.when(failed, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("hit") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when((F.col("hit") == 0) | (F.col("hit") == F.col("bit")), F.col("n")).otherwise(0)).alias("n_kept_without"),
    )
