"""Personal data by weak supervision.

Candidates are what the kinds' patterns match, valid or not, and looser runs of digits
and addresses. Labelers (patterns, gazetteers, context) vote for, against or not at all.
Expectation-maximisation over the counts of all vote patterns estimates how reliable
each labeler is, and its posteriors train the final span classifier, a logistic
regression over votes and shape. Valid base matches always stay; the classifier adds
candidates that touch none of them, unless their kind's check or the words before them
speak against it. Added phone numbers touch no other added span. Built-in expressions
only; all that reaches the driver is a table of vote patterns, whose size the votes bound.

Defined cases: places are code points, ends exclusive; null and empty texts have no
spans; repeated rows give repeated results; without candidates nothing is added.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import text_col
from evenkeel.session import scratch_path

KINDS = ["email", "ip", "card", "phone"]
LOCAL = "[A-Za-z0-9._%+-]"
# Runs that can't be given back are possessive, and a run is entered at its start or where the last match ended: no text takes more than linear time.
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "card": r"(?<![0-9.])[0-9]{4}(?:[\x20.-]?[0-9]{4}){2,3}+(?![0-9])",
    "phone": r"(?<![0-9+])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])",
    "email": rf"(?<!{LOCAL}){LOCAL}++\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
}
CONTEXT = 24  # code points before a candidate
# Words that announce personal data, words that announce other numbers, endings of host names, beginnings of card and of country numbers.
CUES = "mail|e-mail|contact|write|tel|phone|call|fax|mobile|card|visa|ip|host|kontakt|telefon|karte|courriel|carte|correo|tarjeta|teléfono|téléphone"
OTHERS = "version|page|isbn|issn|price|no|nr|section|figure|table|art|line|order|invoice|seite|précio|prix"
ENDINGS = "com|org|net|edu|gov|io|de|fr|es|uk|eu|info"
CARDS = "4[0-9]{12,18}|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|6[0-9]{14,15}"
COUNTRIES = "1|3[0-9]|4[0-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58]"
LABELERS = ["valid", "gazetteer", "cue", "edges", "digits"]
EM_STEPS, NEWTON_STEPS = 50, 25
ADDED_FROM = 0.9  # probability from which a candidate is added


BLOCK, LEVELS = 48, 3  # a running value over a list is taken in blocks of blocks, so lists that grow are copied in parts


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def scan(items: Column, state: Column, step, kind: str, levels: int = LEVELS) -> Column:
    """One element for each item, from a running state: ``step(state, item)`` gives the next state and the element.

    Appending to one list copies it each time. Here only lists of BLOCK items grow by
    single elements, and longer ones by whole blocks, BLOCK times as long at each level.
    """
    nothing = F.array().cast(f"array<{kind}>")

    def over(items: Column, state: Column, level: int) -> Column:
        begin = F.struct(state.alias("state"), nothing.alias("out"))
        if level == 1:

            def one(acc, x):
                following, element = step(acc["state"], x)
                return F.struct(following.alias("state"), F.array_append(acc["out"], element).alias("out"))

            return F.aggregate(items, begin, one)
        size = BLOCK ** (level - 1)
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / size).cast("int")), lambda k: F.slice(items, k * size + 1, size))
        return F.aggregate(blocks, begin, lambda acc, block: bound(over(block, acc["state"], level - 1), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], r["out"]).alias("out"))))

    return bound(items, lambda x: F.when(F.size(x) > 0, over(x, state, levels)["out"]).otherwise(nothing))


SPAN = "struct<start:int,end:int,body:string,before:string,after:string>"


def places(text: Column, pattern: str) -> Column:
    """Start, end and body of a pattern's matches, and what stands around them, from the pieces between them.

    Nothing is looked up in the whole text, so a text of many matches takes linear time.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    # the next code point: of the next piece, or of the next match if that piece is empty
    heads = F.zip_with(F.slice(pieces, 2, F.size(pieces)), F.concat(F.slice(found, 2, F.size(found)), F.array(F.lit(""))), lambda p, b: F.left(F.concat(F.left(p, F.lit(1)), F.left(b, F.lit(1))), F.lit(1)))
    joined = F.zip_with(F.zip_with(found, pieces, lambda b, p: F.struct(b.alias("body"), p.alias("piece"))), heads, lambda x, h: F.struct(x["body"].alias("body"), x["piece"].alias("piece"), h.alias("after")))
    matches = F.filter(joined, lambda x: x["body"].isNotNull())

    def step(state, x):
        begin = state["at"] + F.length(x["piece"])
        end = begin + F.length(x["body"])
        before = F.right(F.concat(state["tail"], F.right(x["piece"], F.lit(CONTEXT))), F.lit(CONTEXT))
        tail = F.right(F.concat(before, F.right(x["body"], F.lit(CONTEXT))), F.lit(CONTEXT))
        span = F.struct(begin.alias("start"), end.alias("end"), x["body"].alias("body"), before.alias("before"), x["after"].alias("after"))
        return F.struct(end.alias("at"), tail.alias("tail")), span

    return scan(F.when(F.size(found) > 0, matches), F.struct(F.lit(0).alias("at"), F.lit("").alias("tail")), step, SPAN)


def digits(body: Column) -> Column:
    return F.regexp_replace(body, "[^0-9]+", "")


def luhn(number: Column) -> Column:
    """Whether the check digit is right; every second digit from the right counts twice, by its digit sum."""

    def weighed(i):
        d = F.substring(number, F.length(number) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.length(number) - 1), weighed), F.lit(0), lambda s, x: s + x) % 10 == 0


def valid(kind: str, body: Column) -> Column:
    number = digits(body)
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = "0*(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return body.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.length(number).between(12, 19) & F.when(F.length(number).between(12, 19), luhn(number)).otherwise(False)
    return F.length(number).between(9, 15)


def gazetteer(kind: str, body: Column) -> Column:
    if kind == "email":
        return F.lower(body).rlike(rf"\.(?:{ENDINGS})$")
    if kind == "ip":
        return ~body.rlike(r"^0*0\.|^0*(?:2[4-9][0-9])\.")
    if kind == "card":
        return digits(body).rlike(f"^(?:{CARDS})$")
    return body.rlike(rf"^\+(?:{COUNTRIES})") | ~body.startswith("+")


def vote(yes: Column, no: Column) -> Column:
    return F.when(yes, F.lit(1)).when(no, F.lit(-1)).otherwise(F.lit(0))


def judged(kind: str, spans: Column, loose: bool) -> Column:
    """Candidates of one kind with the labelers' votes."""

    def one(s):
        body = s["body"]
        before, after = F.lower(s["before"]), s["after"]
        good = valid(kind, body)
        base = F.lit(False) if loose else good
        n = F.length(digits(body))
        votes = [
            vote(good, ~good),
            vote(gazetteer(kind, body), ~gazetteer(kind, body)),
            vote(before.rlike(rf"\b(?:{CUES})\b[^\n]*$"), before.rlike(rf"\b(?:{OTHERS})\b[^\n]{{0,4}}$")),
            vote(before.rlike(r"(?:^|\s)[(\[]?$") & ~after.rlike(r"^[\w@]"), before.rlike(r"\w$") | after.rlike(r"^[\w@]")),
            vote(n.between(9, 19), n < 7) if kind != "email" else F.lit(0),
        ]
        named = [v.cast("int").alias(x) for v, x in zip(votes, LABELERS)]
        return F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end"), base.alias("base"), *named)

    return F.transform(spans, one)


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id, found``: all candidates of every row, base or not, with their votes."""
    text = docs.select("doc_id", text_col(docs).alias("text"))
    digit = F.col("text").rlike("[0-9]")
    none = F.array().cast(f"array<{SPAN}>")
    need = {"email": F.contains("text", F.lit("@")), "ip": digit, "card": digit, "phone": F.contains("text", F.lit("+"))}
    loose_need = {"email": F.lower("text").rlike(r"[(\[]at[)\]]"), "card": digit, "phone": digit}
    base = [F.when(need[k], places(F.col("text"), PATTERNS[k])).otherwise(none).alias(k) for k in KINDS]
    wide = [F.when(loose_need[k], places(F.col("text"), LOOSE[k])).otherwise(none).alias("loose_" + k) for k in LOOSE]
    spans = text.select("doc_id", *base, *wide)
    parts = [judged(k, F.col(k), False) for k in KINDS] + [judged(k, F.col("loose_" + k), True) for k in LOOSE]
    return spans.select("doc_id", F.concat(*parts).alias("found"))


def estimate(patterns: list[tuple[tuple[int, ...], int]]) -> dict[tuple[int, ...], float]:
    """Probability of personal data for each vote pattern, by expectation-maximisation.

    Labelers that vote are taken as independent given the truth; each has a rate of votes
    for among its votes, for either truth.
    """
    n = len(LABELERS)
    p = {v: (1 + sum(v) / n) / 2 for v, _ in patterns}
    for _ in range(EM_STEPS):
        total = sum(c for _, c in patterns)
        prior = (1 + sum(p[v] * c for v, c in patterns)) / (total + 2)
        rate = [[(2.0 if y else 1.0) + sum((p[v] if y else 1 - p[v]) * c for v, c in patterns if v[k] == 1) for k in range(n)] for y in (0, 1)]
        voted = [[3.0 + sum((p[v] if y else 1 - p[v]) * c for v, c in patterns if v[k] != 0) for k in range(n)] for y in (0, 1)]
        for v, _ in patterns:
            logs = [math.log(prior if y else 1 - prior) + sum(math.log(rate[y][k] / voted[y][k] if v[k] == 1 else 1 - rate[y][k] / voted[y][k]) for k in range(n) if v[k]) for y in (0, 1)]
            p[v] = 1 / (1 + math.exp(max(-60.0, min(60.0, logs[0] - logs[1]))))
    return p


def inputs(kind: int, votes: tuple[int, ...]) -> list[float]:
    return [1.0, *(float(kind == k) for k in range(1, len(KINDS))), *(float(v == 1) for v in votes), *(float(v == -1) for v in votes)]


def train(rows: list[tuple[int, tuple[int, ...], int]]) -> list[float]:
    """Weights of the span classifier from ``kind, votes, count`` of all candidates."""
    import numpy as np

    if not rows:
        return []
    by_votes: dict[tuple[int, ...], int] = {}
    for _, v, c in rows:
        by_votes[v] = by_votes.get(v, 0) + c
    posterior = estimate(sorted(by_votes.items()))
    x = np.array([inputs(k, v) for k, v, _ in rows])
    y, c = np.array([posterior[v] for _, v, _ in rows]), np.array([float(n) for _, _, n in rows])
    w = np.zeros(x.shape[1])
    for _ in range(NEWTON_STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (c * p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        w += np.linalg.solve(hessian, x.T @ (c * (y - p)) - w)
    return [float(v) for v in w]


def probability(s: Column, weights: list[float]) -> Column:
    values = [F.lit(1.0), *((s["kind"] == k).cast("double") for k in range(1, len(KINDS)))]
    values += [(s[x] == 1).cast("double") for x in LABELERS] + [(s[x] == -1).cast("double") for x in LABELERS]
    return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, (F.lit(w) * v for w, v in zip(weights, values)))))


def find_pii(docs: DataFrame) -> DataFrame:
    """``doc_id, base, spans``: sorted ``array<struct<start, kind, end>>`` of every row.

    ``kind`` is a place in KINDS. The candidates of all rows are written once, without the
    texts, and read by both the training and the final step.
    """
    path = scratch_path(docs.sparkSession, "candidates")
    candidates(docs).write.parquet(path)
    found = docs.sparkSession.read.parquet(path)
    each = found.where(F.size("found") > 0).select(F.explode("found").alias("s")).select("s.kind", *(f"s.{x}" for x in LABELERS))
    counted = each.groupBy("kind", *LABELERS).agg(F.count("*").alias("n")).collect()  # kinds and votes bound the rows
    weights = train(sorted((r["kind"], tuple(r[x] for x in LABELERS), r["n"]) for r in counted))
    plain = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    base = F.array_sort(F.transform(F.filter("found", lambda s: s["base"]), plain))
    with_base = found.select("doc_id", base.alias("base"), F.filter("found", lambda s: ~s["base"]).alias("rest"))
    if not weights:
        return with_base.select("doc_id", "base", F.col("base").alias("spans"))
    phone = KINDS.index("phone")  # the shape of parts of other numbers, so it comes last
    likely = F.filter("rest", lambda s: (s["valid"] >= 0) & (s["cue"] >= 0) & (probability(s, weights) >= ADDED_FROM))
    rated = with_base.select("doc_id", "base", F.transform(likely, plain).alias("likely"))
    some = rated.select("doc_id", "base", "likely", F.concat("base", apart_from("base", F.filter("likely", lambda s: s["kind"] != phone))).alias("taken"))
    phones = apart_from("taken", F.filter("likely", lambda s: s["kind"] == phone))
    return some.select("doc_id", "base", without_repeats(F.concat("taken", phones)).alias("spans"))


def without_repeats(spans: Column) -> Column:
    """Sorted spans, each once; ``array_union`` would compare every struct with all others."""
    return bound(F.array_sort(spans), lambda a: F.filter(a, lambda s, i: ~s.eqNullSafe(F.get(a, i - 1))))


def apart_from(base: str, spans: Column) -> Column:
    """The spans that overlap none of the column ``base``: one sweep over both in the order of their starts, and one back.

    Forwards a base span that began before reaches into a span if the furthest end so far
    lies beyond its start; backwards one begins inside if the nearest start lies before its end.
    """
    mark = lambda flag: lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), F.lit(flag).alias("base"))
    both = F.array_sort(F.concat(F.transform(base, mark(True)), F.transform(spans, mark(False))))
    kind = "struct<start:int,kind:int,end:int,base:boolean,free:boolean>"

    def sweep(items: Column, first: int, limit, free) -> Column:
        def step(state, s):
            out = F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["base"].alias("base"), (free(state, s) & ~s["base"]).alias("free"))
            return F.when(s["base"], limit(state, s)).otherwise(state), out

        return scan(items, F.lit(first), step, kind)

    forward = sweep(both, 0, lambda reach, s: F.greatest(reach, s["end"]), lambda reach, s: reach <= s["start"])
    # equal starts: the sweep back also meets base spans that begin with the span itself
    backward = sweep(F.reverse(forward), 2147483647, lambda near, s: F.least(near, s["start"]), lambda near, s: s["free"] & (near >= s["end"]))
    left = F.filter(backward, lambda s: s["free"])
    return F.transform(left, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def number_of(spans: str, kind: int) -> Column:
    """How many spans are of one kind."""
    # no default argument in the lambda: Spark would take it for the place in the list
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def listed(spans: str) -> Column:
    """``kind:start:end`` of the spans, joined by commas."""
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")
