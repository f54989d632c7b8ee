"""Per-key work in Spark's own keyed state.

The processors run under ``transformWithState``: the state of a key lives in the
RocksDB store of its task, and a micro-batch reads and writes the keys it touches and no
others. Rows of one key are sorted within the micro-batch; the size of a trigger
(``maxFilesPerTrigger``, ``maxBytesPerTrigger``) bounds what one key can bring at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Row, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from evenkeel.operators.replay import Policy, ReplayConflict

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams started inside keep their state in RocksDB; the session's own setting comes back."""
    was = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if was is None else spark.conf.set(PROVIDER, was)


class Streaks(StatefulProcessor):
    """Consecutive failures of each target; the state is the length of the streak."""

    def __init__(self, columns: Sequence[str], order: Sequence[str], threshold: int):
        self.columns, self.order, self.threshold = list(columns), list(order), threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.streak = handle.getValueState("streak", "streak long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        result = Row(*self.columns, "streak", "alarm")
        streak = self.streak.get()[0] if self.streak.exists() else 0
        for beat in sorted(rows, key=lambda r: [(r[c] is not None, r[c]) for c in self.order]):  # nulls first
            streak = 0 if beat["ok"] else streak + 1
            yield result(*(beat[c] for c in self.columns), streak, streak >= self.threshold)
        self.streak.update((streak,))

    def close(self) -> None:
        pass


#: What the replay gives for a key and micro-batch: its new row, a rejected change, or its share of a checkpoint.
ROW, REJECTED, MARK = "row", "rejected", "mark"


def replay_schema(pk: Sequence[str], state_schema: StructType, kinds: dict[str, str], seq: str, ts: str, table: str) -> str:
    """Key, payload, and the columns that only some kinds of rows have."""
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in state_schema.fields)
    return f"{cols}, __kind string, alive boolean, __seq {kinds[seq]}, __op string, __reason string, __table {kinds[table]}, __ts {kinds[ts]}, __n long"


class Replay(StatefulProcessor):
    """One key's row, whether it is there, and the last position that was applied to it."""

    def __init__(self, pk: Sequence[str], cols: Sequence[str], names: Sequence[str], state: str, seq: str, ts: str, table: str, policy: Policy, carried: str | None):
        self.pk, self.cols, self.names, self.state_schema = list(pk), list(cols), list(names), state
        self.seq, self.ts, self.table, self.policy, self.carried = seq, ts, table, policy, carried

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("row", self.state_schema)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        changes = sorted((r.asDict() for r in rows), key=lambda r: r[self.seq])
        values, alive, last = [None] * len(self.cols), False, None
        known = self.state.exists()
        if known:
            alive, last, *values = self.state.get()
        out, marks, repeats, fresh_from = [], {}, set(), last
        head = dict(zip(self.pk, key))
        for c in changes:
            text = repr(sorted(c.items(), key=lambda kv: kv[0]))
            if text in repeats:
                continue
            repeats.add(text)
            if fresh_from is not None and c[self.seq] <= fresh_from:
                out.append({**head, "__kind": REJECTED, "__seq": c[self.seq], "__op": c["op"], "__reason": "behind the key's last position"})
                continue
            last = c[self.seq]
            mark = marks.setdefault(c[self.table], [last, c[self.ts], 0])
            mark[0], mark[2] = last, mark[2] + 1
            if c[self.ts] is not None and (mark[1] is None or c[self.ts] > mark[1]):
                mark[1] = c[self.ts]
            alive, reason = self.apply(c, values, alive)
            if reason:
                if reason.endswith("abort"):
                    raise ReplayConflict(str({**head, self.seq: last, "outcome": reason}))
                out.append({**head, "__kind": REJECTED, "__seq": last, "__op": c["op"], "__reason": reason})
        if marks:
            self.state.update((alive, last, *values))
            out.append({**head, **dict(zip(self.cols, values)), "__kind": ROW, "alive": alive})
            out += [{**head, "__kind": MARK, "__table": t, "__seq": s, "__ts": when, "__n": n} for t, (s, when, n) in marks.items()]
        result = Row(*self.names)
        for row in out:
            yield result(*(row.get(c) for c in self.names))

    def apply(self, change: dict, values: list, alive: bool) -> tuple[bool, str | None]:
        """Whether the row is there afterwards, and why the change was not applied; ``values`` follows."""
        op = change["op"]
        carries = self.cols if self.carried is None else [c for c in self.cols if c in (change[self.carried] if change[self.carried] is not None else ())]
        if op == "I" and alive:
            if self.policy.on_conflict != "UPSERT":
                return alive, {"SKIP": "conflict_skipped", "ABORT": "conflict_abort"}[self.policy.on_conflict]
        elif op == "I":
            values[:] = [None] * len(values)
        elif op in ("U", "D") and not alive:
            return alive, {"SKIP": "missing_skipped", "ABORT": "missing_abort"}[self.policy.on_missing]
        elif op == "D":
            return False, None
        elif op != "U":
            return alive, "unknown_op"
        for k, c in enumerate(self.cols):
            if c in carries:
                values[k] = change[c]
        return True, None

    def close(self) -> None:
        pass
