"""Mining of report texts: sections, findings, pairs, tables.

A report is one row. Everything that only looks at one report is done inside the
row with array functions, so texts are never shuffled and lines never regrouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The characters that count as white space, and the single ones that break a line.
SPACE_CHARS = "".join(map(chr, [*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
SPACE = "\\x{9}-\\x{d}\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
BREAK_CHARS = [chr(c) for c in (0xB, 0xC, 0xD, 0x1C, 0x1D, 0x1E, 0x85, 0x2028, 0x2029)]
BREAK_CLASS = "[\\x{b}-\\x{d}\\x{1c}-\\x{1e}\\x{85}\\x{2028}\\x{2029}]"
BREAKS = "\\x{d}\\x{a}|" + BREAK_CLASS

# Keywords (any of a tuple; all of a list) and the finding they lead to.
FINDING_RULES: list[tuple[tuple[str, ...] | list[str], str]] = [
    (("section unavailable",), "Some sections were unavailable due to privileges, feature flags, or engine/version differences."),
    (("deadlock",), "Deadlock signals were detected; review lock chains and top contending statements."),
    (("lock wait", "row_lock"), "Lock wait pressure detected; investigate blocking sessions and transaction scope."),
    (("log waits",), "Redo/log write pressure may be present; validate IOPS and log file throughput."),
    (("tmp_disk", "tmp table"), "Temporary object usage observed; inspect sort/hash memory limits and query patterns."),
    (("blocking_session_id", "head blocker"), "Blocking chain data is present; check head blockers, transaction scope, and lock duration."),
    (("memory grants pending", "resource_semaphore"), "Memory grant pressure indicators are present; inspect grant queues and large query concurrency."),
    (("pageiolatch", "io/log", "writelog"), "IO or log-write pressure indicators are present; correlate file latency with top read/write statements."),
    (("query store",), "Query Store data is available; compare runtime outliers and plan regressions against recent change windows."),
    (("innodb_deadlocks", "innodb_row_lock_waits"), "InnoDB deadlock or row lock wait pressure detected; investigate lock order and transaction scope."),
    (("created_tmp_disk_tables",), "Temporary disk table usage detected; consider raising tmp_table_size/max_heap_table_size."),
    (("innodb_log_waits",), "InnoDB log wait pressure present; consider increasing innodb_log_buffer_size."),
    (("select_full_join", "no_index_used"), "Full-table scan or no-index-used signals present; review query plans and index coverage."),
    (("slave_sql_running", "replica_sql_running"), "Replication data is present; validate replica lag and IO/SQL thread state."),
    (("wal_buffers_full", "checkpoints_req"), "PostgreSQL WAL/checkpoint pressure signals detected; review checkpoint cadence and write bursts."),
    (("n_dead_tup", "autovacuum"), "Table bloat or autovacuum pressure may be present; inspect dead tuples and vacuum throughput."),
    (("aggregate pga", "over allocation count"), "Oracle PGA pressure indicators detected; validate memory targets and workarea policy."),
    (["tablespace", "used_percent"], "Tablespace utilization data present; review high used-percent tablespaces for capacity risk."),
]
NO_FINDING = "No explicit high-risk indicators were auto-detected; validate against workload SLO baselines."

# Title keywords and the section label, first match wins.
SECTION_LABELS: list[tuple[tuple[str, ...], str]] = [
    (("wait",), "Primary wait pressure across tasks, categories, and active chains."),
    (("active requests", "ash"), "Current workload sample showing sessions, waits, and top in-flight statements."),
    (("cpu", "duration", "read and write"), "High-cost statements ranked by resource consumption and runtime impact."),
    (("blocking", "deadlock"), "Concurrency diagnostics for blockers, victims, and transaction contention."),
    (("memory", "tempdb"), "Memory grant, buffer, and workspace pressure indicators."),
    (("alwayson", "replica"), "Availability group synchronization and replica health status."),
    (("io", "log"), "Storage latency, file pressure, and recovery/log utilization signals."),
    (("query store",), "Plan/runtime history useful for regression and outlier detection."),
    (("buffer pool",), "InnoDB buffer pool utilization, hit ratio, and dirty page pressure."),
    (("innodb io", "log pressure"), "InnoDB IO, redo log, and page operation pressure indicators."),
    (("statement wait",), "Performance Schema wait events sorted by cumulative wait time - analogous to AWR Top Wait Events."),
    (("lock wait", "transaction"), "Concurrency diagnostics: InnoDB lock waits, deadlocks, and long-running transactions."),
    (("table io",), "Per-table read/write latency - analogous to AWR Segment IO statistics."),
    (("wal", "checkpoint"), "WAL generation and checkpoint behavior indicating write pressure and durability cadence."),
    (("vacuum", "analyze"), "Autovacuum and statistics maintenance posture for bloat and planner stability."),
    (("slot health",), "Replication slot and stream health, including lag and retention risk indicators."),
    (("sga", "pga"), "Oracle memory pool sizing and pressure indicators across SGA/PGA components."),
    (("tablespace",), "Tablespace usage posture and free-space pressure hotspots."),
    (("undo",), "Undo retention pressure and transaction rollback segment health signals."),
    (("user and host", "session mix"), "User/host session distribution and activity breakdown."),
    (("schema", "inventory"), "Object inventory, sizing, and storage allocation."),
    (("binary log",), "Binary log status, GTID state, and log file inventory."),
    (("replication",), "Replication channel state, lag, and IO/SQL thread health."),
    (("rows examined", "execution count", "temp disk", "errors"), "High-cost SQL ranked by a secondary resource or error dimension."),
    (("throughput", "workload"), "Aggregate workload throughput counters since last restart."),
    (("configuration", "server config"), "Key server configuration parameters affecting performance and durability."),
    (("active sessions", "ash"), "Current workload sample showing in-flight sessions, states, and SQL."),
]
UNAVAILABLE_LABEL = "This section could not be collected on the target due to permissions or feature availability."
DEFAULT_LABEL = "Detailed engine telemetry captured for this diagnostic slice."


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_CHARS))


def normal_lines(c: Column) -> Column:
    """Every kind of line break as one newline, without a closing one."""
    # most texts only have plain newlines; byte searches find the others far faster than a pattern
    odd = F.contains(c, F.lit(BREAK_CHARS[0]))
    for ch in BREAK_CHARS[1:]:
        odd = odd | F.contains(c, F.lit(ch))
    return (
        F.when(odd, F.regexp_replace(F.regexp_replace(c, BREAKS, "\n"), r"\n\z", ""))
        .when(F.endswith(c, F.lit("\n")), F.substr(c, F.lit(1), F.length(c) - 1))
        .otherwise(c)
    )


def split_sections(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """One row per section with its number, title and content.

    Text ahead of the first header is the Overview. A header with no line after it
    is dropped; one followed only by blank lines keeps an empty content.
    """
    led = F.when(F.length(text) > 0, F.concat(F.lit("\n"), normal_lines(F.col(text)))).otherwise("")
    pieces = F.split(led, "\n## ")
    has_lines = lambda p, i: F.when(i == 0, F.length(p) > 0).otherwise(F.contains(p, F.lit("\n")))

    def section(p: Column, i: Column) -> Column:
        cut = F.instr(p, "\n")
        title = F.when(i == 0, "Overview").otherwise(strip(F.substring_index(p, "\n", 1)))
        return F.when(
            has_lines(p, i), F.struct(title.alias("title"), strip(F.substr(p, cut + 1)).alias("content"))
        )

    sections = F.array_compact(F.transform(pieces, section))
    out = df.select(*keys, F.posexplode(sections).alias("section_no", "s"))
    return out.select(*keys, (F.col("section_no") + 1).cast("long").alias("section_no"), "s.title", "s.content")


def _any_of(c: Column, words) -> Column:
    hits = [F.contains(c, F.lit(w)) for w in words]
    out = hits[0]
    for h in hits[1:]:
        out = (out & h) if isinstance(words, list) else (out | h)
    return out


def findings(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """One row per finding of each report; the default where no rule applies."""
    low = df.select(*keys, F.lower(text).alias("__low"))
    hits = F.array_compact(F.array(*[F.when(_any_of(F.col("__low"), words), F.lit(f)) for words, f in FINDING_RULES]))
    return low.select(*keys, hits.alias("h")).select(*keys, F.explode(F.when(F.size("h") > 0, F.col("h")).otherwise(F.array(F.lit(NO_FINDING)))).alias("finding"))


def summarise(sections: DataFrame) -> DataFrame:
    """Label of each section by its title, then its content."""
    title = F.lower("title")
    label = None
    for words, text in SECTION_LABELS:
        hit = _any_of(title, words)
        label = F.when(hit, text) if label is None else label.when(hit, text)
    label = label.when(F.contains(F.lower("content"), F.lit("section unavailable")), UNAVAILABLE_LABEL).otherwise(DEFAULT_LABEL)
    return sections.withColumn("label", label)


def kv_pairs(df: DataFrame, content: str, keys: list[str]) -> DataFrame:
    """``key: value`` lines in order; the first four are the hero metrics."""
    lines = F.filter(F.split(normal_lines(F.col(content)), "\n"), lambda l: F.contains(l, F.lit(":")))
    pairs = F.transform(
        lines,
        lambda l: F.struct(
            strip(F.substring_index(l, ":", 1)).alias("key"), strip(F.substr(l, F.instr(l, ":") + 1)).alias("value")
        ),
    )
    kept = F.filter(pairs, lambda p: (F.length(p["key"]) > 0) & (F.length(p["value"]) > 0))
    out = df.select(*keys, F.posexplode(kept).alias("position", "p"))
    return out.select(*keys, (F.col("position") + 1).cast("long").alias("position"), "p.key", "p.value", (F.col("position") < 4).alias("hero"))


def pipe_tables(df: DataFrame, content: str, keys: list[str]) -> DataFrame:
    """Rows of pipe tables as header and cell arrays and a map.

    A table is a block of lines without a blank one, with a header line, a dashed
    rule and at least one row of as many cells as the header.
    """
    text = F.concat(F.lit("\n"), normal_lines(F.col(content)), F.lit("\n"))
    blocks = F.filter(F.split(text, f"\n(?:[{SPACE}]*\n)+"), lambda b: F.length(strip(b)) > 0)

    def cells(line: Column) -> Column:
        return F.transform(F.split(line, r"\|"), strip)

    def table(block: Column) -> Column:
        lines = F.split(F.regexp_replace(block, r"^\n|\n$", ""), "\n")
        head = cells(lines[0])
        body = F.filter(F.slice(lines, 3, F.greatest(F.size(lines) - 2, F.lit(0))), lambda l: F.contains(l, F.lit("|")))
        rows = F.filter(F.transform(body, cells), lambda r: F.size(r) == F.size(head))
        is_table = (F.size(lines) >= 2) & F.contains(lines[0], F.lit("|")) & F.try_element_at(lines, F.lit(2)).rlike("^[| -]*-[| -]*$")
        return F.when(is_table, F.struct(head.alias("header"), rows.alias("rows")))

    tables = df.select(*keys, F.posexplode(F.transform(blocks, table)).alias("block_no", "t")).where(F.col("t").isNotNull())
    rows = tables.select(*keys, (F.col("block_no") + 1).cast("long").alias("block_no"), F.col("t.header").alias("header"), F.posexplode("t.rows").alias("row_no", "cells"))
    return rows.withColumn("row_no", (F.col("row_no") + 1).cast("long"))


def as_record(rows: DataFrame) -> DataFrame:
    """Header to cell map of each table row; a repeated header keeps its last cell."""
    entries = F.arrays_zip(F.col("header").alias("k"), F.col("cells").alias("v"))
    last = F.filter(
        F.transform(entries, lambda e, i: F.struct(e["k"], e["v"], i.alias("i"))),
        lambda e: ~F.array_contains(F.slice(F.col("header"), e["i"] + 2, F.greatest(F.size("header") - e["i"] - 1, F.lit(0))), e["k"]),
    )
    return rows.withColumn("record", F.map_from_entries(F.transform(last, lambda e: F.struct(e["k"], e["v"]))))


def unavailable_count(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """How often a report says a section is unavailable."""
    return df.select(*keys, F.regexp_count(F.lower(text), F.lit("section unavailable")).cast("long").alias("unavailable_count"))
