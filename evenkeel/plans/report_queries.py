"""Reports made from whole documents: header block, sections, a pipe table, an unavailable part."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.operators import reports as rp
from evenkeel.plans.registry import Tables, query

TAIL = {
    0: "## Deadlock and waits\nSection unavailable: no access\nretry: yes\n",
    1: "## Log waits\n\nname | total | note\n--- | --- | ---\nwritelog | 1 | a:b\nshort | 2\nlatch|3|\n\nfree text\n",
    2: "## Empty part\n\n## Dropped header",
    3: "## Tablespace usage\nname|used_percent\n----|----\nUSERS | 91\n\nname | x\nno rule | 1\n",
    4: "",
}


def _tail(quote, newline) -> str:
    whens = " ".join(f"WHEN {k} THEN {quote(v)}" for k, v in TAIL.items())
    return f"CASE doc_id % 5 {whens} END"


def _spark_text(v: str) -> str:
    return "'" + v.replace("\n", "\\n") + "'"


def _duck_text(v: str) -> str:
    return " || chr(10) || ".join("'" + part + "'" for part in v.split("\n"))


SPARK_REPORT = (
    "concat('Host: h', doc_id, '\\nEngine: ', lang, '\\nSource : ', source, '\\nEmpty:\\n\\n', "
    "array_join(transform(split(text, '\\n'), (x, i) -> CASE WHEN i % 3 = 2 THEN concat('## ', x) ELSE x END), '\\n'), '\\n', "
    + _tail(_spark_text, None)
    + ")"
)
NL = "chr(10)"
DUCK_REPORT = (
    f"concat('Host: h', doc_id, {NL}, 'Engine: ', lang, {NL}, 'Source : ', source, {NL}, 'Empty:', {NL}, {NL}, "
    f"array_to_string(list_transform(string_split(text, {NL}), lambda x, i: CASE WHEN (i - 1) % 3 = 2 THEN '## ' || x ELSE x END), {NL}), {NL}, "
    + _tail(_duck_text, None)
    + ")"
)
REPORTS = f"(SELECT doc_id, {DUCK_REPORT} AS report FROM documents)"


def reports(t: Tables):
    return t.documents.select("doc_id", F.expr(SPARK_REPORT).alias("report"))


def stripped(c: str) -> str:
    return f"regexp_replace({c}, '^[{rp.SPACE}]+|[{rp.SPACE}]+$', '', 'g')"


def lines_of(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '{rp.BREAKS}', chr(10), 'g'), '\\n\\z', '')"


SECTIONS = f"""(SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS section_no, title, content FROM (
   SELECT doc_id, i, CASE WHEN i = 1 THEN 'Overview' ELSE {stripped("string_split(p, chr(10))[1]")} END AS title, {stripped("substr(p, instr(p, chr(10)) + 1)")} AS content
   FROM (SELECT doc_id, unnest(ps) AS p, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT doc_id, string_split(chr(10) || {lines_of('report')}, chr(10) || '## ') AS ps FROM {REPORTS}))
   WHERE CASE WHEN i = 1 THEN length(p) > 0 ELSE contains(p, chr(10)) END))"""


def sections(t: Tables):
    return rp.split_sections(reports(t), "report", ["doc_id"])


@query("r01_split_sections", f"SELECT doc_id, section_no, title, content FROM {SECTIONS}")
def split(t: Tables):
    return sections(t)


def _has(words, col="low") -> str:
    glue = " AND " if isinstance(words, list) else " OR "
    return "(" + glue.join(f"contains({col}, '{w}')" for w in words) + ")"


HITS = ", ".join(f"CASE WHEN {_has(w)} THEN '{f}' END" for w, f in rp.FINDING_RULES)


@query(
    "r02_findings",
    f"""SELECT doc_id, unnest(CASE WHEN len(h) > 0 THEN h ELSE ['{rp.NO_FINDING}'] END) AS finding FROM (SELECT doc_id, list_filter([{HITS}], lambda x: x IS NOT NULL) AS h FROM (SELECT doc_id, lower(report) AS low FROM {REPORTS}))""",
)
def found(t: Tables):
    return rp.findings(reports(t), "report", ["doc_id"])


LABELS = " ".join(f"WHEN {_has(w, 'lower(title)')} THEN '{x}'" for w, x in rp.SECTION_LABELS)


@query(
    "r03_section_labels",
    f"SELECT doc_id, section_no, CASE {LABELS} WHEN contains(lower(content), 'section unavailable') THEN '{rp.UNAVAILABLE_LABEL}' ELSE '{rp.DEFAULT_LABEL}' END AS label FROM {SECTIONS}",
)
def labelled(t: Tables):
    return rp.summarise(sections(t)).select("doc_id", "section_no", "label")


@query(
    "r04_kv_pairs",
    f"""SELECT doc_id, section_no, position, key, value, position <= 4 AS hero FROM (SELECT doc_id, section_no, key, value, row_number() OVER (PARTITION BY doc_id, section_no ORDER BY i) AS position FROM (
      SELECT doc_id, section_no, i, {stripped("substr(l, 1, instr(l, ':') - 1)")} AS key, {stripped("substr(l, instr(l, ':') + 1)")} AS value FROM (
        SELECT doc_id, section_no, unnest(ls) AS l, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, section_no, string_split({lines_of('content')}, chr(10)) AS ls FROM {SECTIONS})) WHERE contains(l, ':'))
      WHERE key <> '' AND value <> '')""",
)
def pairs(t: Tables):
    return rp.kv_pairs(sections(t), "content", ["doc_id", "section_no"])


@query(
    "r05_pipe_tables",
    f"""WITH l AS (SELECT doc_id, section_no, i, l, sum(CASE WHEN {stripped('l')} = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, section_no ORDER BY i) AS b FROM (
        SELECT doc_id, section_no, unnest(ls) AS l, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, section_no, string_split({lines_of('content')}, chr(10)) AS ls FROM {SECTIONS}))),
      k AS (SELECT doc_id, section_no, b, list(l ORDER BY i) AS ls FROM l WHERE {stripped('l')} <> '' GROUP BY 1, 2, 3),
      n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, section_no ORDER BY b) AS block_no FROM k),
      q AS (SELECT doc_id, section_no, block_no, list_transform(string_split(ls[1], '|'), lambda x: {stripped('x')}) AS h,
          list_filter(list_transform(list_filter(ls[3:], lambda x: contains(x, '|')), lambda x: list_transform(string_split(x, '|'), lambda y: {stripped('y')})), lambda r: len(r) = len(string_split(ls[1], '|'))) AS rs
        FROM n WHERE len(ls) >= 2 AND contains(ls[1], '|') AND regexp_full_match(ls[2], '[| -]*-[| -]*'))
      SELECT doc_id, section_no, block_no, array_to_string(h, '^') AS header, unnest(range(1, len(rs) + 1)) AS row_no, array_to_string(unnest(rs), '^') AS cells FROM q""",
)
def tables(t: Tables):
    rows = rp.pipe_tables(sections(t), "content", ["doc_id", "section_no"])
    return rows.select("doc_id", "section_no", "block_no", F.array_join("header", "^").alias("header"), "row_no", F.array_join("cells", "^").alias("cells"))


@query("r06_unavailable_count", f"SELECT doc_id, len(string_split(lower(report), 'section unavailable')) - 1 AS unavailable_count FROM {REPORTS}")
def unavailable(t: Tables):
    return rp.unavailable_count(reports(t), "report", ["doc_id"])
