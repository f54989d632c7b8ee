"""Report parsing against a line-by-line reading of the same texts."""

import random

import pytest

from conftest import rows
from evenkeel.operators import reports as rp

HAND = [
    "Host: a\nEngine: pg\n## One\nbody\n\n## Two\n## Three\n\n## Four",
    "## Only\nx",
    "\n## After blank\ny\n",
    "",
    "\n",
    "## A\r\nwindows: yes\r\n## B\r\n",
    "##NoSpace\n ## indented\n## \nempty title",
    "a|b\n-|-\n1|2\n\n  \nc | d\n---|---\n 3 | 4 \n5\n6|7|8\n| - |\n## T\nx|x\n--- --- | -\n1|2",
    "k: v\n:novalue\nnokey:\nurl: http://x:1 \nDEADLOCK and Section Unavailable section unavailable",
    "tablespace only\n## tablespace used_percent\nfree text: odd",
]


def texts():
    rnd = random.Random(4)
    parts = ["## H", "", " ", "word", "a: b", "x | y", "--- | ---", "1 | 2", "|-|", "## ", "##", "tmp table", "1|2|3", "\tpad "]
    return HAND + ["\n".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 25))) for _ in range(150)]


@pytest.fixture(scope="module")
def data():
    return list(enumerate(texts()))


@pytest.fixture(scope="module")
def frame(spark, data):
    return spark.createDataFrame(data, "id long, t string")


def sections(text):
    found, title, body = [], "Overview", None
    for line in text.splitlines():
        if line.startswith("## "):
            if body is not None:
                found.append((title, "\n".join(body).strip()))
            title, body = line[3:].strip(), None
        else:
            body = [*(body or []), line]
    if body is not None:
        found.append((title, "\n".join(body).strip()))
    return found


def test_sections(frame, data):
    want = [(i, n, *s) for i, t in data for n, s in enumerate(sections(t), 1)]
    assert rows(rp.split_sections(frame, "t", ["id"]), "id", "section_no", "title", "content") == sorted(want, key=repr)


def test_pairs(frame, data):
    want = []
    for i, t in data:
        n = 0
        for line in t.splitlines():
            key, colon, value = line.partition(":")
            if colon and key.strip() and value.strip():
                n += 1
                want.append((i, n, key.strip(), value.strip(), n <= 4))
    assert rows(rp.kv_pairs(frame, "t", ["id"])) == sorted(want, key=repr)


def tables(text):
    blocks, block = [], []
    for line in [*text.splitlines(), ""]:
        if line.strip():
            block.append(line)
        elif block:
            blocks.append(block)
            block = []
    for n, b in enumerate(blocks, 1):
        rule = b[1].replace("|", "").replace(" ", "") if len(b) > 1 else ""
        if "|" in b[0] and rule and set(rule) == {"-"}:
            head = [c.strip() for c in b[0].split("|")]
            body = [[c.strip() for c in x.split("|")] for x in b[2:] if "|" in x]
            for r, cells in enumerate([c for c in body if len(c) == len(head)], 1):
                yield n, head, r, cells


def test_tables(frame, data):
    out = rp.as_record(rp.pipe_tables(frame, "t", ["id"]))
    want = [(i, *x, dict(zip(x[1], x[3]))) for i, t in data for x in tables(t)]
    assert len(want) > 5
    assert rows(out, "id", "block_no", "header", "row_no", "cells", "record") == sorted(want, key=repr)


def test_findings_and_counts(frame, data):
    got = {}
    for i, f in rows(rp.findings(frame, "t", ["id"])):
        got.setdefault(i, set()).add(f)
    for i, t in data:
        low = t.lower()
        want = {f for words, f in rp.FINDING_RULES if (all if isinstance(words, list) else any)(w in low for w in words)}
        assert got[i] == (want or {rp.NO_FINDING})
    counts = dict(rows(rp.unavailable_count(frame, "t", ["id"])))
    assert counts == {i: t.lower().count("section unavailable") for i, t in data}


@pytest.mark.parametrize(
    "title, content, label",
    [
        ("Top WAIT events", "", rp.SECTION_LABELS[0][1]),
        ("Flash cache", "", rp.SECTION_LABELS[1][1]),
        ("Tablespace", "", "Tablespace usage posture and free-space pressure hotspots."),
        ("Misc", "Section unavailable now", rp.UNAVAILABLE_LABEL),
        ("Misc", "", rp.DEFAULT_LABEL),
    ],
)
def test_labels(spark, title, content, label):
    assert rp.summarise(spark.createDataFrame([(title, content)], "title string, content string")).first().label == label
