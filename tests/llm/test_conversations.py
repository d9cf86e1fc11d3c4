import functools
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from panelwright.llm import conversations as cv

SCHEMA = "conv_id long, turn long, role string, text string"
GOOD = re.compile(r"(s?(ua)+)?")
BLANKS = " \t\n\x0b\f\r"


def brute(rows):
    """Report of one conversation, its rows (turn, role, text) given after damage, by plain recursion."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(BLANKS)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen
                      else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    n = len(rows)

    def after(state, initial):  # states: text so far "", "s", "u", "a"
        ok = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        return initial if initial and initial in ok else None

    @functools.cache
    def best(i, state, inserted):
        found = []
        if i == n and state in ("", "a"):
            found.append((0, "", ()))
        if i < n:
            role, text, fault = rows[i][1], rows[i][2], faults[i]
            extra = 5 if fault == "truncated" else 0
            cost, audit, out = best(i + 1, state, 0)
            found.append((cost + 2, "D" + audit, out))
            if fault not in ("blank", "duplicate"):
                to = after(state, role[:1])
                if to:
                    cost, audit, out = best(i + 1, to, 0)
                    found.append((cost + extra, "K" + audit, ((role, text), *out)))
                for new in ("user", "assistant"):
                    if after(state, new[0]):
                        cost, audit, out = best(i + 1, new[0], 0)
                        found.append((cost + 1 + extra, "R" + audit, ((new, text), *out)))
        if inserted < 3:
            for new in ("user", "assistant"):
                if after(state, new[0]):
                    cost, audit, out = best(i, new[0], inserted + 1)
                    found.append((cost + 5, "I" + audit, ((new, ""), *out)))
        return min(found, key=lambda f: f[:2]) if found else (10 ** 9, "", ())

    cost, audit, out = best(0, "", 0)
    assert GOOD.fullmatch("".join(r[:1] for r, _ in out))
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        "cost": cost, "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()}


def harmed(rows):
    """Rows by conversation after the damage."""
    text = lambda v: " " if v is None else str(v)
    found = {}
    for conv, turn, role, body in rows:
        role, body = text(role), text(body)
        draw = zlib.crc32(f"{text(conv)}:{text(turn)}".encode()) % 20
        kept = found.setdefault(conv, [])
        if draw == 0:
            continue
        body = "" if draw == 1 else re.sub("[.!?]", "", body) if draw == 2 else body
        kept += [(turn, "user" if draw == 4 else role, body)] * (2 if draw == 3 else 1)
    return found


@pytest.fixture(scope="module")
def talks():
    draw = random.Random(3)
    rows = []
    for conv in [None, *range(60)]:
        shown = draw.randrange(1, 9)
        for turn in range(shown):
            role = draw.choice(["user", "assistant", "system", "tool", "umpire", "", None]) \
                if draw.random() < 0.3 else ("user", "assistant")[turn % 2]
            text = draw.choice(["", None, " \n", "open end", "Fine.", "Fine.\t", "é!", "a\nb?"]) \
                if draw.random() < 0.5 else f"Turn {draw.randrange(99)}."
            rows.append((conv, draw.choice([None, turn, turn, turn, turn + 3]), role, text))
    rows += [(7, 1, "user", "Same.")] * 5                                  # repeated rows
    rows += [(99, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(70)]
    rows += [(100, t, draw.choice(["user", "assistant", "system", "x"]), draw.choice(["", "a", "b.", f"{t}!"]))
             for t in range(90)]
    rows.append((101, None, None, None))
    rows.append((102, 0, "system", "x" * 300_000 + "."))
    return rows


@pytest.mark.parametrize("chunk", [3, 4096])
def test_report(spark, talks, chunk):
    rows = spark.createDataFrame(talks, SCHEMA).withColumn("pos", F.lit("clash")).withColumn(
        "fault", F.lit(1)).repartition(5)
    got = {r.conv_id: r.asDict() for r in cv.repair_report(cv.damaged(rows), rows, chunk=chunk).collect()}
    want = harmed(talks)
    assert set(got) == set(want)
    for conv, kept in want.items():
        assert got[conv] == {"conv_id": conv, **brute(kept)}, conv


def test_fixup_passes_reach_far(spark):
    """A choice at the end that decides edits many chunks before it."""
    rows = [(1, t, "tool", "x.") if t == 0 else (1, t, ("user", "assistant")[t % 2], f"{t}.")
            for t in range(60)] + [(1, 60, "system", "end"), (2, 0, "user", "a."), (2, 1, "assistant", "b.")]
    got = {r.conv_id: r for r in cv.repair_report(spark.createDataFrame(rows, SCHEMA), chunk=2).collect()}
    for conv in (1, 2):
        want = brute([r[1:] for r in rows if r[0] == conv])
        assert {k: got[conv][k] for k in want} == want


def test_vectors_differ_by_constants_only_when_parallel():
    search = cv.Search(cv.Costs())
    draw = random.Random(5)
    for _ in range(200):
        codes = [draw.randrange(12) for _ in range(draw.randrange(1, 12))]
        full = search.end
        for code in reversed(codes):
            full = search.raw_before(full, code)
        assert search.vectors(codes, search.end)[0] == tuple(x - min(full) for x in full)
        old = search.vectors(codes, cv._GUESS)[0]
        assert search.fixed_up(codes, cv._GUESS, old, search.end) == search.vectors(codes, search.end)[0]


def test_repaired_rows_are_in_order(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "More."), (1, 2, "assistant", "cut"), (1, 3, "tool", "")]
    marked = cv.stored(cv.marked(spark.createDataFrame(rows, SCHEMA)))
    lines = cv.repaired(marked, cv.traced(marked)).orderBy("pos", "sub").collect()
    want = brute([r[1:] for r in rows])
    assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in lines).encode()).hexdigest() == \
        want["repaired_sha256"]


def test_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert cv.repair_report(cv.damaged(none), none).count() == 0
