"""Line dedup by winnowing over line hashes.

A run of lines counts from WINDOW non-blank lines on, or from LONG words on, were they on
a single line. So the windows of a text are all its WINDOW consecutive non-blank lines,
and all shorter runs of consecutive lines that have LONG words. Every window is
represented by its smallest line hash: equal windows have equal minima, so a run that
occurs twice is sure to share a fingerprint. Only windows whose fingerprint was selected
elsewhere too are joined, by a 96-bit hash of all their lines; windows that match and
overlap grow into the maximal run on both sides of the fingerprint. The earliest
occurrence of a window stays (by ``doc_id``, nulls last, then by place); a line goes if a
window around it has an earlier equal one. Built-in expressions only.

Defined cases: lines are compared without blanks, tabs and carriage returns around
them; blank lines are never compared and stay; null and empty texts keep their empty
text; rows equal in ``doc_id`` and text are one document and lose nothing to each
other; texts without a window stay whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import doc_key, keyed, text_col
from evenkeel.session import cut_lineage

WINDOW = 3  # lines; the shortest run that counts as a repeat whatever its words
LONG = 50  # words; a run of that many counts whatever its lines


def line_hashes(rows: DataFrame) -> DataFrame:
    """``key, doc_id, pairs``: two hashes and the number of words of each non-blank line of a text, in order."""
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    trimmed = rows.select("key", "doc_id", F.transform(lines, lambda x: F.btrim(x, F.lit(" \t\r"))).alias("lines"))
    words = lambda x: F.length(F.regexp_replace(F.regexp_replace(x, r"[^\x20\x09-\x0D]+", "w"), r"[\x20\x09-\x0D]+", ""))
    pairs = F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("h"), F.hash(x).alias("g"), words(x).alias("n")))
    return trimmed.where(F.size("lines") > 0).select("key", "doc_id", pairs.alias("pairs"))


def windows(hashes: DataFrame, width: int) -> DataFrame:
    """``key, doc_id, start, lines, low, place, w1, w2``: every window, its minimum (the rightmost of equals) and its hash."""

    def of(lines: int):
        """All windows of so many lines, short ones only with enough words."""
        starts = F.sequence(F.lit(0), F.size("pairs") - lines)
        if lines < width:
            starts = F.filter(starts, lambda i: F.aggregate(F.slice("pairs", i + 1, lines), F.lit(0), lambda n, x: n + x["n"]) >= LONG)
        return F.when(F.size("pairs") >= lines, F.transform(starts, lambda i: F.struct(i.alias("start"), F.lit(lines).alias("lines"))))

    none = F.array().cast("array<struct<start:int,lines:int>>")
    places = F.concat(*(F.coalesce(of(lines), none) for lines in range(1, width + 1)))
    rows = hashes.select("key", "doc_id", "pairs", F.explode(places).alias("window")).select("key", "doc_id", "pairs", "window.*")
    part = F.slice("pairs", F.col("start") + 1, F.col("lines"))
    cut = rows.select("key", "doc_id", "start", "lines", part["h"].alias("h"), part["g"].alias("g"))
    low = F.array_min("h")
    place = F.col("start") + F.col("lines") - F.array_position(F.reverse("h"), low).cast("int")
    return cut.select("key", "doc_id", "start", "lines", low.alias("low"), place.alias("place"), F.xxhash64("h", "g").alias("w1"), F.hash("g", "h").alias("w2"))


def repeated_windows(hashes: DataFrame, width: int) -> DataFrame:
    """``key, start, lines`` of every window that has an earlier equal one."""
    every = cut_lineage(windows(hashes.dropDuplicates(["key"]), width))
    selected = every.groupBy("low").agg(F.min("key").alias("k1"), F.max("key").alias("k2"), F.min("place").alias("p1"), F.max("place").alias("p2"))
    shared = cut_lineage(selected.where("k1 <> k2 OR p1 <> p2").select("low"))
    candidates = every.join(shared, "low", "left_semi").select("key", "doc_id", "start", "lines", "w1", "w2")
    order = F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "key", "start")
    first = cut_lineage(candidates.groupBy("w1", "w2", "lines").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1"))
    back = candidates.join(first.select("w1", "w2", "lines", F.col("first.key").alias("first_key"), F.col("first.start").alias("first_start")), ["w1", "w2", "lines"])
    return back.where("key <> first_key OR start <> first_start").select("key", "start", "lines")


def without_repeats(docs: DataFrame, width: int) -> DataFrame:
    """``row struct, key, n_lines, removed, kept``: every row as it was, and what is left of its text."""
    rows = docs.select(F.struct("*").alias("row"), text_col(docs).alias("text"), doc_key(docs).alias("key"))
    starts = repeated_windows(line_hashes(keyed(docs)), width).groupBy("key").agg(F.collect_set(F.struct("start", "lines")).alias("starts"))
    split = rows.join(starts, "key", "left").select("row", "key", "starts", F.split("text", "\n", -1).alias("lines"))
    filled = F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(r"[^\x20\x09-\x0D]"), i)), lambda i: i.isNotNull())
    places = split.withColumn("filled", F.when(F.col("starts").isNotNull(), filled))
    gone = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.transform(F.sequence(s["start"], s["start"] + s["lines"] - 1), lambda c: F.col("filled")[c]))))
    marked = places.select("row", "key", "lines", F.coalesce(gone, F.array().cast("array<int>")).alias("removed"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "removed")
    kept = F.when(F.size("removed") == 0, F.col("lines")).otherwise(F.transform(left, lambda i: F.col("lines")[i]))
    return marked.select("row", "key", F.size("lines").alias("n_lines"), F.array_sort("removed").alias("removed"), F.array_join(kept, "\n").alias("kept"))


def dedup_lines(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """``doc_id, key, n_lines, removed array<int>, kept string``: one row for each row of ``docs``.

    ``n_lines`` counts the parts between line feeds, ``removed`` has the numbers of those
    that go (from 0), ``kept`` is the text without them.
    """
    return without_repeats(docs.select("doc_id", "text"), width).select(F.col("row.doc_id").alias("doc_id"), "key", "n_lines", "removed", "kept")


def drop_repeats(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` with shortened texts; rows go that lost lines and have no word left.

    A column ``n_chars`` follows the new text.
    """
    done = without_repeats(docs, width).where((F.size("removed") == 0) | F.col("kept").rlike(r"[^\x20\x09-\x0D]"))
    changed = F.size("removed") > 0
    new = {"text": F.when(changed, F.col("kept")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("kept")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return done.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
