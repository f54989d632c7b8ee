"""Conversation structure repair by a persistent audit DP.

A conversation is repaired by the cheapest edits after which its role initials read
``(s?(ua)+)?``. A row is kept (K, 0), given the role user or assistant (R, 3) or deleted
(D, 4, forced for blank and duplicate rows); empty turns are inserted (I, 3); a truncated
row that stays costs 3 more. Of equally cheap edits the ASCII-least audit counts.

Audits are nodes that share their prefixes: a node has its parent, the letters it adds,
its ancestors at distances 1, 2, 4, ... and a rolling hash. A tie is decided by the first
node in which two audits differ, found by doubling steps over the ancestors' hashes and
verified by the identity of the shared prefix; a collision is settled letter by letter.

Rows are numbered in one sorted order (conversation, turn, role, text, copy). Tasks read
ranges of these numbers and turn every stretch of a conversation into a table "cheapest
audit from state x to state y"; the tables of a conversation, one for each stretch, are
chained by the same DP. So a conversation may be cut anywhere, and only its audit, one
letter a row, and the digest of its repaired text need one task, which streams them.

Defined cases: a null ``conv_id`` is a conversation of its own; null turns sort first and
count for no gap; null role and text are one space (such a text is blank); rows with the
same turn are ordered by role, then text; an empty table gives no rows; a conversation
without rows left has zeros and empty results. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from evenkeel.session import cut_lineage, scratch_path

STRETCH = 20_000  # rows of one conversation that are turned into a table at once
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3  # costs
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
START, SYSTEM, USER, ASSISTANT = range(4)  # the last initial so far
NAMES = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
TURN = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # which role may be made after a state
FILL = {START: 2, SYSTEM: 2, USER: 1, ASSISTANT: 1}  # more inserts in one place are never cheapest
CLOSE = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}  # inserts needed at the end
BASE, PRIME = 1_000_003, (1 << 61) - 1
LEGAL = {"su", "ua", "au"}


class Audits:
    """Audits as linked nodes. Node 0 is the empty audit.

    Audits that are compared have equally many nodes, and no node's letters are the
    beginning of another's with the same parent, so the first difference decides.
    """

    def __init__(self):
        self.up: list[tuple[int, ...]] = [()]
        self.letters, self.hash, self.made = [""], [0], {}

    def add(self, parent: int, letters: str) -> int:
        node = self.made.get((parent, letters))
        if node is not None:
            return node
        node = len(self.up)
        above, k = [parent], 0
        while k < len(self.up[above[k]]):
            above.append(self.up[above[k]][k])
            k += 1
        value = self.hash[parent]
        for c in letters if len(letters) < 8 else hashlib.blake2b(letters.encode(), digest_size=16).hexdigest():
            value = (value * BASE + ord(c)) % PRIME
        self.up.append(tuple(above))
        self.letters.append(letters)
        self.hash.append(value)
        self.made[parent, letters] = node
        return node

    def split(self, a: int, b: int) -> tuple[int, int]:
        """The first nodes in which two different audits of equally many nodes differ."""
        x, y = a, b
        for k in range(len(self.up[x]) - 1, -1, -1):
            if k < len(self.up[x]) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                x, y = self.up[x][k], self.up[y][k]
        if self.up[x][0] == self.up[y][0]:
            return x, y
        x, y = a, b  # equal hashes of different prefixes: step by step
        while self.up[x][0] != self.up[y][0]:
            x, y = self.up[x][0], self.up[y][0]
        return x, y

    def less(self, a: tuple[int, str], b: tuple[int, str]) -> bool:
        """Whether node and letters ``a`` read before ``b``."""
        if a[0] == b[0]:
            return a[1] < b[1]
        x, y = self.split(a[0], b[0])
        return self.letters[x] < self.letters[y]

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letters[node])
            node = self.up[node][0]
        return "".join(reversed(out))


def steps(initial: str, fault: int) -> list[list[tuple[int, int, str]]]:
    """For each state the ways over one row: next state, cost, letters; the inserts stand before the row."""
    free = fault not in (BLANK, DUPLICATE)
    more = CUT if fault == TRUNCATED else 0
    out = []
    for start in range(4):
        ways, state = [], start
        for n in range(FILL[start] + 1):
            fill = "I" * n
            ways.append((state, n * INSERT + DELETE, fill + "D"))
            if free:
                ways.append((TURN[state], n * INSERT + REROLE + more, fill + "R"))
                if initial == NAMES[TURN[state]][0]:
                    ways.append((TURN[state], n * INSERT + KEEP + more, fill + "K"))
                elif initial == "s" and state == START:
                    ways.append((SYSTEM, n * INSERT + KEEP + more, fill + "K"))
            state = TURN[state]
        out.append(ways)
    return out


STEPS = {(i, f): steps(i, f) for i in ("s", "u", "a", "") for f in (NONE, BLANK, TRUNCATED)}


def advance(audits: Audits, best: dict[int, tuple[int, int]], ways: list[list[tuple[int, int, str]]]) -> dict[int, tuple[int, int]]:
    """The cheapest (cost, audit) of each state after one more row or stretch."""
    found: dict[int, tuple[int, tuple[int, str]]] = {}
    for state, (cost, node) in best.items():
        for to, more, letters in ways[state]:
            was = found.get(to)
            if was is None or cost + more < was[0] or (cost + more == was[0] and audits.less((node, letters), was[1])):
                found[to] = (cost + more, (node, letters))
    return {to: (cost, audits.add(*last)) for to, (cost, last) in found.items()}


class Stretch:
    """Consecutive rows of one conversation: their counts and the table of cheapest audits."""

    def __init__(self, conv_id, seq: int, whole: bool):
        self.conv_id, self.seq = conv_id, seq
        self.starts = [START] if whole else [START, SYSTEM, USER, ASSISTANT]
        self.audits = [Audits() for _ in self.starts]
        self.best = [{s: (0, 0)} for s in self.starts]
        self.faults, self.illegal, self.rows = [0, 0, 0, 0], 0, 0
        self.first_initial = self.last_initial = None
        self.first_turn = self.last_turn = None
        self.turns = 0

    def add(self, turn, initial: str, fault: int) -> None:
        if self.rows:
            self.illegal += self.last_initial + initial not in LEGAL
        else:
            self.first_initial = initial
        self.last_initial = initial
        self.rows += 1
        self.faults[fault] += 1
        if turn is not None:
            if self.first_turn is None:
                self.first_turn = turn
            self.turns += turn != self.last_turn
            self.last_turn = turn
        ways = STEPS[initial if initial in ("s", "u", "a") else "", BLANK if fault == DUPLICATE else fault]
        self.best = [advance(a, b, ways) for a, b in zip(self.audits, self.best)]

    def row(self) -> dict:
        table = [(s, to, cost, audits.text(node)) for s, audits, best in zip(self.starts, self.audits, self.best) for to, (cost, node) in best.items()]
        return {
            "conv_id": self.conv_id, "seq": self.seq, "blank": self.faults[BLANK], "duplicate": self.faults[DUPLICATE], "truncated": self.faults[TRUNCATED],
            "illegal": self.illegal, "first_initial": self.first_initial, "last_initial": self.last_initial, "first_turn": self.first_turn,
            "last_turn": self.last_turn, "turns": self.turns, "ways": [{"start": s, "to": t, "cost": c, "audit": a} for s, t, c, a in table],
        }


def stretch_schema(id_type: str) -> str:
    counts = ", ".join(f"{c} long" for c in ("seq", "blank", "duplicate", "truncated", "illegal"))
    ends = "first_initial string, last_initial string, first_turn long, last_turn long, turns long"
    return f"conv_id {id_type}, {counts}, {ends}, ways array<struct<start:int,to:int,cost:long,audit:string>>"


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copy``: rows dropped, emptied, cut, repeated or given the role user by a checksum."""
    name = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (F.crc32(name) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.where("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def numbered(rows: DataFrame) -> DataFrame:
    """``seq, conv_id, turn, role, text``: ``seq`` rises in the order of the conversation; written, so that it stays."""
    order = ["conv_id", "turn", "role", "text", "copy"]
    path = scratch_path(rows.sparkSession, "turns")
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.monotonically_increasing_id().alias("seq"), "conv_id", "turn", "role", "text").write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def with_faults(rows: DataFrame) -> DataFrame:
    """``seq, conv_id, turn, initial, fault`` of numbered rows; the first fault of each."""
    same = rows.select("seq", "conv_id", F.md5(F.concat_ws("\x00", F.length("role").cast("string"), "role", "text")).alias("same"))
    first = same.groupBy("conv_id", "same").agg(F.min("seq").alias("seq")).select("seq", F.lit(True).alias("new"))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    whole = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    light = rows.select("seq", "conv_id", "turn", F.substring("role", 1, 1).alias("initial"), blank.alias("blank"), whole.alias("whole"))
    fault = F.when(F.col("blank"), BLANK).when(F.col("new").isNull(), DUPLICATE).when(~F.col("whole"), TRUNCATED).otherwise(NONE)
    return light.join(first, "seq", "left").select("seq", "conv_id", "turn", "initial", fault.alias("fault"))


def stretches(faults: DataFrame, most: int = STRETCH) -> DataFrame:
    """Every conversation as one or more stretches of up to ``most`` rows."""

    def rows_of(stream: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        now, first = None, True
        for batch in stream:
            for seq, conv_id, turn, initial, fault in zip(*(batch.column(c).to_pylist() for c in ("seq", "conv_id", "turn", "initial", "fault"))):
                if now is None or conv_id != now.conv_id or now.rows >= most:
                    inner = now is not None and conv_id != now.conv_id  # its beginning is here: it can only start anew
                    if now is not None:
                        yield now.row()
                    now = Stretch(conv_id, seq, inner)
                now.add(turn, initial, fault)
        if now is not None:
            yield now.row()

    ddl = stretch_schema(faults.schema["conv_id"].dataType.simpleString())
    schema = schema_of(ddl)
    return faults.repartitionByRange("seq").sortWithinPartitions("seq").mapInArrow(lambda stream: in_batches(rows_of(stream), schema), ddl)


def schema_of(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def in_batches(rows: Iterator[dict], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of ``size`` rows."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def chained(parts: Iterable[dict]) -> dict:
    """One conversation from its stretches in order: counts, cost and audit."""
    audits, best = Audits(), {START: (0, 0)}
    out = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
    initial = first_turn = last_turn = None
    turns = 0
    for part in parts:
        for k in out:
            out[k] += part[k]
        if initial is not None:
            out["illegal"] += initial + part["first_initial"] not in LEGAL
        initial = part["last_initial"]
        if part["first_turn"] is not None:
            first_turn = part["first_turn"] if first_turn is None else first_turn
            turns += part["turns"] - (part["first_turn"] == last_turn)
            last_turn = part["last_turn"]
        ways: list[list[tuple[int, int, str]]] = [[] for _ in range(4)]
        for way in part["ways"]:
            ways[way["start"]].append((way["to"], way["cost"], way["audit"]))
        best = advance(audits, best, ways)
    ends = [(cost + INSERT * CLOSE[state], audits.text(node) + "I" * CLOSE[state]) for state, (cost, node) in best.items()]
    cost, audit = min(ends)
    gaps = 0 if first_turn is None else last_turn - first_turn + 1 - turns
    return {"gaps": gaps, **out, "cost": cost, "audit": audit}


def by_conversation(rows: Iterator[dict]) -> Iterator[tuple[object, Iterator[dict]]]:
    """Sorted rows as (conv_id, its rows), without holding them."""
    return groupby(rows, key=lambda r: r["conv_id"])


def solve(faults: DataFrame, most: int = STRETCH) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` of every conversation that has rows."""
    parts = stretches(faults, most)
    id_type = faults.schema["conv_id"].dataType.simpleString()
    ddl = f"conv_id {id_type}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    schema = schema_of(ddl)

    def work(stream):
        rows = (row for batch in stream for row in batch.to_pylist())
        return in_batches(({"conv_id": conv_id, **chained(group)} for conv_id, group in by_conversation(rows)), schema)

    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "seq").mapInArrow(work, ddl)


def edited(rows: Iterable[dict], audit: str) -> Iterator[dict]:
    """The repaired turns: ``edit`` (K, R or I), ``role`` and ``text`` in order."""
    state, rows = START, iter(rows)
    for letter in audit:
        if letter == "I":
            state = TURN[state]
            yield {"edit": "I", "turn": None, "role": NAMES[state], "text": ""}
            continue
        row = next(rows)
        if letter == "D":
            continue
        if letter == "K":
            state = SYSTEM if row["role"][:1] == "s" else TURN[state]
            yield {"edit": "K", "turn": row["turn"], "role": row["role"], "text": row["text"]}
        else:
            state = TURN[state]
            yield {"edit": "R", "turn": row["turn"], "role": NAMES[state], "text": row["text"]}


def streamed(rows: DataFrame, solved: DataFrame) -> DataFrame:
    """Each conversation's audit as a row of its own before its turns, in the order of the turns."""
    audits = solved.select("conv_id", F.lit(-1).cast("long").alias("seq"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
    both = rows.select("conv_id", "seq", "turn", "role", "text").unionByName(audits)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "seq")


def repaired_turns(rows: DataFrame, solved: DataFrame) -> DataFrame:
    """``conv_id, place, edit, turn, role, text``: the repaired conversations; inserted turns have no number."""
    ddl = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, place long, edit string, turn long, role string, text string"
    schema = schema_of(ddl)

    def turns(stream):
        for conv_id, group in by_conversation(row for batch in stream for row in batch.to_pylist()):
            for place, turn in enumerate(edited(group, next(group)["text"])):
                yield {"conv_id": conv_id, "place": place, **turn}

    return streamed(rows, solved).mapInArrow(lambda stream: in_batches(turns(stream), schema), ddl)


def digests(rows: DataFrame, solved: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256``: digest of the repaired ``role:text`` lines, taken turn by turn."""
    ddl = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string"
    schema = schema_of(ddl)

    def digest(stream):
        for conv_id, group in by_conversation(row for batch in stream for row in batch.to_pylist()):
            sha = hashlib.sha256()
            for place, turn in enumerate(edited(group, next(group)["text"])):
                sha.update((("\n" if place else "") + f"{turn['role']}:{turn['text']}").encode())
            yield {"conv_id": conv_id, "repaired_sha256": sha.hexdigest()}

    return streamed(rows, solved).mapInArrow(lambda stream: in_batches(digest(stream), schema), ddl)


def repair(rows: DataFrame, most: int = STRETCH) -> tuple[DataFrame, DataFrame]:
    """Numbered turns and the solution of each conversation, from ``conv_id, turn, role, text, copy``."""
    turns = numbered(rows)
    return turns, cut_lineage(solve(with_faults(turns), most))


def audit_report(conversations: DataFrame, most: int = STRETCH) -> DataFrame:
    """Damaged and repaired conversations: one row for each ``conv_id`` of the table."""
    turns, solved = repair(damage(conversations), most)
    asked = conversations.select("conv_id").distinct().withColumn("id", F.struct("conv_id"))
    done = solved.withColumn("id", F.struct("conv_id")).drop("conv_id")
    digest = digests(turns, solved).withColumn("id", F.struct("conv_id")).drop("conv_id")
    joined = asked.join(done, "id", "left").join(digest, "id", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    return joined.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
