"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document; the ledger keeps the measurements and
one bit for each rule that failed. Policies are versioned masks over these bits, so a
new policy or an ablation reads the ledger only and never the texts. Built-in
expressions only; a document is measured within its row, so nothing is shuffled.

Defined cases: words are runs without blanks and the control characters 9 to 13; null
and empty texts have no words, all counts are 0 and they fail the rule on few words;
shares of nothing count as 0; repeated rows give repeated results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import text_col

SPACE = r"\x20\x09-\x0D"
GRAM = 8  # words of a window that is looked for elsewhere in the text

# bit, name, and when the rule fails, over the measurements
RULES: list[tuple[int, str, str]] = [
    (0, "few_words", "n_words < 20"),
    (1, "repeated_words", "100 * n_repeat_words > 30 * n_words"),
    (2, "symbols", "10 * n_symbols > n_words"),
    (3, "exclamations", "5 * n_exclamations > n_words"),
    (4, "capitals", "2 * n_capitals > word_chars"),
    (5, "repeated_lines", "2 * n_dup_lines > n_lines"),
    (6, "word_length", "n_words > 0 AND NOT word_chars BETWEEN 3 * n_words AND 12 * n_words"),
    (7, "few_different_words", "10 * n_unique_words < 3 * n_words"),
]
BITS = {name: 1 << bit for bit, name, _ in RULES}
BASE = BITS["few_words"] | BITS["repeated_words"]
POLICIES = {"base": BASE, "v1": BASE | BITS["symbols"] | BITS["exclamations"], "v2": sum(BITS.values())}
LATEST = "v2"


def only(text: Column, characters: str) -> Column:
    """How many of these characters the text has."""
    return F.length(F.regexp_replace(text, f"[^{characters}]+", "")).cast("long")


def pairs(items: Column, combine) -> Column:
    """``combine`` of each element and the next one."""
    n = F.size(items) - 1
    return F.zip_with(F.slice(items, 1, n), F.slice(items, 2, n), combine)


def repeated_words(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more.

    Sorting puts equal windows side by side; the places of those with an equal neighbour
    are sorted again, and each adds the words up to the next place, GRAM at most.
    """
    tagged = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    nothing = F.array().cast("array<int>")
    twice = F.flatten(pairs(tagged, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(nothing)))
    places = F.array_sort(F.array_distinct(twice))
    return F.aggregate(pairs(places, lambda a, b: F.least(b - a, F.lit(GRAM))), F.lit(GRAM), lambda s, x: s + x).cast("long")


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the measurements of every row of ``docs``."""
    text = docs.select("doc_id", text_col(docs).alias("text"))
    trimmed = F.btrim("text", F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE}]+"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    split = text.select("doc_id", "text", words.alias("words"), lines.alias("lines"))
    grams = F.transform(F.sequence(F.lit(1), F.size("words") - (GRAM - 1)), lambda i: F.xxhash64(F.slice("words", i, GRAM)))
    hashed = split.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        only(F.col("text"), "#*$%&|<>").alias("n_symbols"),
        only(F.col("text"), "!").alias("n_exclamations"),
        only(F.col("text"), r"\p{Lu}").alias("n_capitals"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_unique_words"),
        F.when(F.size("words") > GRAM, grams).otherwise(F.array().cast("array<bigint>")).alias("grams"),
    )
    has_repeats = F.size(F.array_distinct("grams")) < F.size("grams")
    return hashed.withColumn("n_repeat_words", F.when(has_repeats, repeated_words(F.col("grams"))).otherwise(F.lit(0).cast("long"))).drop("grams")


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements with ``failed``, a bit for each rule that the document fails."""
    bits = [F.when(F.expr(fails), F.lit(1 << bit)).otherwise(F.lit(0)) for bit, _, fails in RULES]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measure(docs).withColumn("failed", failed)


def apply_policy(ledger: DataFrame, version: str = LATEST) -> DataFrame:
    """The ledger with ``policy`` and ``kept``: no rule of that version failed."""
    mask = POLICIES[version]
    return ledger.withColumn("policy", F.lit(version)).withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask)) == 0)


def ablation(ledger: DataFrame, version: str = LATEST) -> DataFrame:
    """``rule, failing, alone``: documents a rule rejects, and those only this rule of the version rejects.

    One pass that counts each combination of bits; the combinations are then combined
    with the rules' masks.
    """
    mask = POLICIES[version]
    counts = ledger.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("failed")).agg(F.count("*").alias("n"))
    rules = F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(BITS[name]).alias("bit")) for _, name, _ in RULES if BITS[name] & mask))
    each = counts.select("failed", "n", F.explode(rules).alias("r")).select("failed", "n", "r.rule", "r.bit")
    fails = F.col("failed").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(
        F.sum(F.when(fails, F.col("n")).otherwise(0)).alias("failing"), F.sum(F.when(F.col("failed") == F.col("bit"), F.col("n")).otherwise(0)).alias("alone")
    )
