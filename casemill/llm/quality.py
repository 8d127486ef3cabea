"""Quality rules as a ledger: every rule is evaluated once, its failure is one bit beside the measurements.

A policy is a named, versioned mask of bits. Verdicts, counts and ablations read the stored bits; no text is read again.
Everything is column expressions on one row, so the ledger needs no shuffle; reports shuffle one row per bit pattern.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.functions.arrays import let

SPACES = " \t\n\x0b\f\r"

#: Rule names in bit order. New rules are appended, so old ledgers keep their meaning.
RULES = ("few_words", "repeated_words", "symbols", "repeated_lines", "word_length", "shouting", "few_letters")


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << RULES.index(r) for r in self.rules)


#: ``base`` is the pair of rules of the contract; ``v1`` adds the others.
BASE = Policy("base", ("few_words", "repeated_words"))
V1 = Policy("v1", RULES)


def words(text: Column) -> Column:
    """Words between runs of the six white-space characters; none for a null, empty or blank text."""
    return let(F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES)), lambda t: F.when(
        t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"[\x20\x09-\x0D]+")))


def repeated_words(w: Column) -> Column:
    """Words that stand in a window of three words found twice or more in the text.

    Windows are hashed and compared inside the row. Most texts have no window twice and stop at the distinct count;
    the others sort (hash, place), keep places whose neighbour has the same hash, and add up the covered words.
    """
    last = F.size(w) - 3
    hashes = F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(
        F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>"))

    def places(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(ordered, lambda s: F.transform(F.filter(s, lambda e, k: (
            F.coalesce(e["h"] == F.get(s, k - 1)["h"], F.lit(False)) | F.coalesce(e["h"] == F.get(s, k + 1)["h"], F.lit(False))
        )), lambda e: e["i"]))

    def covered(at: Column) -> Column:
        return let(F.sort_array(at), lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.coalesce(F.least(F.get(p, k + 1) - x, F.lit(3)), F.lit(3))),
            F.lit(0), lambda total, x: total + x))

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(places(h))))


def measurements(text: Column) -> Column:
    """Every number the rules need, as one struct; the text and its words are each worked out once per row."""
    def of(t: Column, w: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
        return F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
            F.size(lines).cast("bigint").alias("n_lines"),
            repeated_words(w).cast("bigint").alias("n_repeat_words"),
            F.regexp_count(t, F.lit(r"\p{Lu}")).cast("bigint").alias("n_upper"),
            F.regexp_count(t, F.lit(r"\p{L}")).cast("bigint").alias("n_letters"),
        )
    return let(F.coalesce(text, F.lit("")), lambda t: let(words(t), lambda w: of(t, w)))


def failures(m: Column) -> Column:
    """Failure bits of the measurements. Thresholds are whole-number comparisons, so an edge falls the same way everywhere."""
    failed = {
        "few_words": m["n_words"] < 50,
        "repeated_words": 100 * m["n_repeat_words"] > 50 * m["n_words"],
        "symbols": 100 * m["n_symbols"] > 10 * m["n_words"],
        "repeated_lines": 100 * m["n_dup_lines"] > 50 * m["n_lines"],
        "word_length": (2 * m["word_chars"] < 5 * m["n_words"]) | (m["word_chars"] > 15 * m["n_words"]),
        "shouting": 100 * m["n_upper"] > 50 * m["n_letters"],
        "few_letters": 100 * m["n_letters"] < 50 * m["word_chars"],
    }
    bits = F.lit(0).cast("bigint")
    for i, name in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(failed[name], F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint"))
    return bits


def passes(bits: Column, policy: Policy) -> Column:
    return bits.bitwiseAND(F.lit(policy.mask)) == 0


def entry(text: Column) -> Column:
    """One ledger entry: the measurements with ``failed``, the bits. A null text counts as empty."""
    return let(measurements(text), lambda m: m.withField("failed", failures(m)))


def ledger(docs: DataFrame) -> DataFrame:
    """``doc_id, source`` and the ledger entry of every row; null ids and repeated rows stay. Store it, then apply policies."""
    source = F.col("source") if "source" in docs.columns else F.lit(None).cast("string")
    return docs.select("doc_id", source.alias("source"), entry(F.col("text")).alias("e")).select("doc_id", "source", "e.*")


def verdicts(book: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with ``kept`` under the policy."""
    return book.withColumn("kept", passes(F.col("failed"), policy))


def ablations(book: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of the policy: ``n_failed``, ``n_only`` (rows that only this rule rejects), ``n_kept_without`` it.

    One count per bit pattern, at most 2 to the number of rules, then bit arithmetic; an empty ledger gives zeros.
    """
    patterns = book.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES.index(r)).cast("bigint").alias("bit"))
                                for r in policy.rules])).alias("r")
    one = F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0))
    only = F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0))
    kept = F.sum(F.when(F.col("bits").isin(0) | (F.col("bits") == F.col("r.bit")), F.col("n")).otherwise(0))
    zero = book.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("bits"), F.lit(0).cast("bigint").alias("n"))
    return (patterns.unionByName(zero).select("bits", "n", rules).groupBy(F.lit(policy.version).alias("policy"), F.col("r.rule").alias("rule"))
            .agg(one.alias("n_failed"), only.alias("n_only"), kept.alias("n_kept_without")))


def combined(book: DataFrame, *by: str) -> DataFrame:
    """Per group: the bits that any row fails and those that every row fails."""
    return book.groupBy(*by).agg(F.bit_or("failed").alias("any_failed"), F.bit_and("failed").alias("all_failed"), F.count("*").alias("n"))
