"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per text. The ledger keeps the measurements and one bit per
failed rule, so a policy is a mask over bits, and what each rule costs (its ablation) comes
from a count per distinct bit pattern, without reading a text again.

Everything is a column expression. A missing text counts as empty; an empty text has no
word, no line and fails the word-count rule. Repeated rows give repeated rows. Other columns
of the input are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from aquagrid.llm.common import BLANKS, whole_text

SYMBOLS = "#*$%&|<>"
CAPITALS = "A-Z"
POSITION_BITS = 28

#: Rules in bit order: name and condition of failure over the measurements.
RULES = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "5 * n_symbols > n_words",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
    "capitals": "10 * n_capitals > 3 * word_chars",
    "long_words": "word_chars > 20 * n_words",
    "short_words": "word_chars < 2 * n_words",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]

#: Policies by version: the rules that reject a text.
POLICIES = {
    "v1": BASE,
    "v2": reduce(lambda a, b: a | b, BIT.values()),
}

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
            "n_capitals"]


def _count_of(text: Column, characters: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{characters}]+", "")).cast("bigint")


def _window_hashes(word_hashes) -> Column:
    """One 64-bit hash per 3-word window."""
    windows = F.size(word_hashes) - 2
    hashes = F.transform(word_hashes, lambda x, i: F.xxhash64(
        x, F.get(word_hashes, i + 1), F.get(word_hashes, i + 2)))
    return F.slice(hashes, F.lit(1), F.greatest(windows, F.lit(0)))


def _packed(hashes) -> Column:
    """The hashes sorted, each with its position in its low bits: one sort of longs."""
    keep = F.lit(~((1 << POSITION_BITS) - 1))
    return F.sort_array(F.transform(
        hashes, lambda x, i: x.bitwiseAND(keep).bitwiseOR(i.cast("bigint"))))


def _neighbours(packed) -> Column:
    """Places in the sorted array whose next entry has the same high bits."""
    return F.filter(F.transform(packed, lambda x, i: F.when(
        F.shiftright(x, POSITION_BITS) == F.shiftright(F.get(packed, i + 1), POSITION_BITS), i)),
        lambda j: j.isNotNull())


def _confirmed(hashes, packed, neighbours) -> Column:
    """Full hash and position of all windows in runs of equal high bits, sorted, so equal windows
    meet whatever lies between them."""
    at = F.lit((1 << POSITION_BITS) - 1)

    def position(j):
        return F.get(packed, j).bitwiseAND(at).cast("int")

    places = F.array_distinct(F.concat(neighbours, F.transform(neighbours, lambda j: j + 1)))
    return F.sort_array(F.transform(places, lambda j: F.struct(
        F.get(hashes, position(j)).alias("h"), position(j).alias("p"))))


def _repeated_starts(confirmed) -> Column:
    """Positions of the windows found twice or more."""
    pairs = F.transform(confirmed, lambda x, i: F.when(
        x["h"] == F.get(confirmed, i + 1)["h"],
        F.array(x["p"], F.get(confirmed, i + 1)["p"])))
    return F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull()))))


def _covered(starts) -> Column:
    """Words covered by 3-word windows at the sorted positions ``starts``."""
    lengths = F.transform(starts, lambda s, i: F.least(
        F.coalesce(F.get(starts, i + 1) - s, F.lit(3)), F.lit(3)).cast("bigint"))
    return F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, x: a + x)


def measure(docs: DataFrame, key="doc_id", text="text") -> DataFrame:
    """The measurements of every text, by key."""
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    parts = (docs.select(F.col(key), whole_text(text).alias("_text"))
             .select(key, "_text", F.array_remove(F.split("_text", BLANKS), "").alias("_words"),
                     lines.alias("_lines"))
             .select(key, F.size("_words").cast("bigint").alias("n_words"),
                     F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
                     _count_of(F.col("_text"), SYMBOLS).alias("n_symbols"),
                     _count_of(F.col("_text"), CAPITALS).alias("n_capitals"),
                     F.size("_lines").cast("bigint").alias("n_lines"),
                     (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint")
                     .alias("n_dup_lines"),
                     F.transform("_words", lambda x: F.xxhash64(x)).alias("_hashes"))
             .withColumn("_windows", _window_hashes(F.col("_hashes"))).drop("_hashes")
             .withColumn("_packed", _packed(F.col("_windows")))
             .withColumn("_next", _neighbours(F.col("_packed")))
             .withColumn("_same", _confirmed(
                 F.col("_windows"), F.col("_packed"), F.col("_next")))
             .withColumn("_starts", _repeated_starts(F.col("_same"))))
    return parts.withColumn("n_repeat_words", _covered(F.col("_starts"))).select(key, *MEASURES)


def ledger(docs: DataFrame, key="doc_id", text="text") -> DataFrame:
    """Measurements and ``fail_bits`` (bit i is set where rule i fails) of every text."""
    bits = [F.when(F.expr(fails), F.lit(BIT[name]).cast("bigint")).otherwise(
        F.lit(0).cast("bigint")) for name, fails in RULES.items()]
    return measure(docs, key, text).withColumn(
        "fail_bits", reduce(lambda a, b: a.bitwiseOR(b), bits))


def apply_policy(book: DataFrame, policy="v2") -> DataFrame:
    """Add ``base_failed`` and ``kept`` under a policy (a version name or a mask)."""
    mask = POLICIES[policy] if isinstance(policy, str) else int(policy)
    bits = F.col("fail_bits")
    failed = bits.bitwiseAND(F.lit(BASE)) != 0
    return book.withColumns({"base_failed": failed,
                             "kept": ~failed & (bits.bitwiseAND(F.lit(mask)) == 0)})


def ablations(book: DataFrame, policy="v2") -> DataFrame:
    """Per rule of a policy: texts that fail it, texts that fail nothing else (they return if
    the rule is dropped), and texts kept with and without it."""
    mask = POLICIES[policy] if isinstance(policy, str) else int(policy)
    patterns = (book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits"))
                .agg(F.count("*").alias("n")))
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(bit).cast("bigint").alias("bit"))
                      for name, bit in BIT.items() if mask & bit])
    hit, only = F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("bits") == F.col("bit")

    def total(condition):
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    return (patterns.select("bits", "n", F.inline(rules)).groupBy("rule")
            .agg(total(hit).alias("failing"), total(only).alias("only_this"),
                 total(F.col("bits") == 0).alias("kept"))
            .withColumn("kept_without", F.col("kept") + F.col("only_this")))


_FAILS = " or ".join(f"({RULES[name]})" for name in RULES if BIT[name] & POLICIES["v2"])

ORACLE = r"""
with d as (select row_number() over () as rid, doc_id, coalesce("text", '') as t from documents),
w as (select rid, doc_id, t,
        list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
        list_filter(string_split(t, chr(10)),
                    lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
pos as (select rid, unnest(range(1, len(words) - 1)) as i from w where len(words) >= 3),
tri as (select p.rid, p.i, words[p.i] as a, words[p.i + 1] as b, words[p.i + 2] as c
        from pos p join w using (rid)),
rep as (select rid, i from (select rid, i, count(*) over (partition by rid, a, b, c) as n
        from tri) where n > 1),
cov as (select rid, count(distinct j) as n from
        (select rid, unnest([i, i + 1, i + 2]) as j from rep) group by rid),
m as (select w.rid, doc_id, len(words) as n_words,
        length(array_to_string(words, '')) as word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols,
        length(regexp_replace(t, '[^A-Z]', '', 'g')) as n_capitals,
        len(lines) as n_lines, len(lines) - len(list_distinct(lines)) as n_dup_lines,
        coalesce(cov.n, 0) as n_repeat_words
      from w left join cov on cov.rid = w.rid)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
  not (""" + _FAILS + ") as kept from m"


def op3(spark, folder):
    """The rows of the contract, from the ledger under the current policy."""
    from aquagrid.llm.common import table
    return apply_policy(ledger(table(spark, folder, "documents"))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")
