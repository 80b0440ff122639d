"""Repair of conversations against a search over all edits, its SQL, and odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict
from itertools import groupby

import pytest

from benchloom.llm import conversation_repair as cr
from benchloom.llm import queries

from ..compare import database, from_duckdb, from_spark

BLANKS = " \t\n\x0b\x0c\r"


def faults_of(rows):
    """rows (role, text) in order."""
    seen, out = set(), []
    for role, text in rows:
        kind = "b" if not text.strip(BLANKS) else "d" if (role, text) in seen else "t" if text.rstrip(BLANKS)[-1] not in ".!?" else "-"
        seen.add((role, text))
        out.append(kind)
    return out


def well_formed(initials):
    rest = initials[1:] if initials[:1] == "s" else initials
    return len(rest) % 2 == 0 and rest == "ua" * (len(rest) // 2) and (rest or not initials)


def brute(rows, most=2):
    """Least (cost, audit) over all edits with at most `most` inserts in one place, and the repaired rows."""
    faults, best = faults_of(rows), None

    def go(i, cost, audit, out, run):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(rows) and well_formed("".join(r[:1] or "?" for r, _ in out)):
            best = min(best or (cost, audit, out), (cost, audit, out), key=lambda x: x[:2])
        if run < most:
            for role in ("user", "assistant"):
                go(i, cost + 5, audit + "I", [*out, (role, "")], run + 1)
        if i < len(rows):
            go(i + 1, cost + 2, audit + "D", out, 0)
            if faults[i] not in "bd":
                more = 5 * (faults[i] == "t")
                go(i + 1, cost + more, audit + "K", [*out, rows[i]], 0)
                for role in ("user", "assistant"):
                    go(i + 1, cost + more + 1, audit + "R", [*out, (role, rows[i][1])], 0)

    go(0, 0, "", [], 0)
    return best


def test_parse_equals_search():
    rng = random.Random(3)
    for _ in range(60):
        rows = [(rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(["a.", "b!", "c?", "d", "e", " ", "", "f."])) for _ in range(rng.randrange(5))]
        faults = faults_of(rows)
        cost, audit = cr.accepted(cr.parse([(r[:1], f) for (r, _), f in zip(rows, faults, strict=True)]))
        want = brute(rows)
        assert (cost, audit) == want[:2], rows
        assert [(r, t) for e, r, t in cr.edited(audit, rows) if e != "D"] == want[2]


def damaged(rows):
    """(turn, role, text) of each conversation after the query's damage, in the operator's order."""
    held = defaultdict(list)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else text.translate({46: None, 33: None, 63: None}) if kind == 2 else text
        held[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest())) for c, v in held.items()}


def plain(rows):
    """The query's result by a left-to-right table over the four beginnings, kept as tuples."""
    out = {}
    for conv, turns in damaged(rows).items():
        faults, table = faults_of([t[1:] for t in turns]), {"": (0, "")}

        def insert(t):
            for _ in range(3):
                for a, b in (("", "u"), ("s", "u"), ("p", "u"), ("u", "p")):
                    if a in t:
                        t[b] = min(t.get(b, (9**9,)), (t[a][0] + 5, t[a][1] + "I"))
            return t

        table = insert(table)
        for (_, role, _), f in zip(turns, faults, strict=True):
            new = {k: (c + 2, a + "D") for k, (c, a) in table.items()}
            for k, (c, a) in table.items() if f not in "bd" else ():
                c += 5 * (f == "t")
                options = [("p" if k == "u" else "u", "a" if k == "u" else "u", "K", 0), ("p" if k == "u" else "u", None, "R", 1)] + [("s", "s", "K", 0)] * (k == "")
                for to, wants, letter, price in options:
                    if wants in (None, role[:1]):
                        new[to] = min(new.get(to, (9**9,)), (c + price, a + letter))
            table = insert(new)
        cost, audit = min(table[k] for k in ("", "p") if k in table)
        said, rest, n = [], iter(turns), 0
        for letter in audit:
            _, role, text = (None, None, "") if letter == "I" else next(rest)
            if letter != "D":
                role = role if letter == "K" else "assistant" if n % 2 else "user"
                n += role[:1] != "s"
                said.append(f"{role}:{text}")
        known = [t[0] for t in turns if t[0] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        out[conv] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    return {c: out.get(c, nothing) for c in {r[0] for r in rows}}


def result(df):
    got = df.collect()
    found = {r.conv_id: tuple(r)[1:] for r in got}
    assert len(found) == len(got)
    return found


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in queries.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert result(queries.op11_conversation_repair(spark, sf_dir)) == plain(rows)


def test_query_equals_sql(spark, sf_dir):
    assert from_spark(queries.op11_conversation_repair(spark, sf_dir)) == from_duckdb(database(sf_dir), cr.SQL)


SCHEMA = "conv_id long, turn long, role string, text string, at long, whole boolean, edits string, n long, first int"


def odd_rows(rows):
    return [(*r, 1, True, "x", 2, 3) for r in rows]


@pytest.mark.parametrize("turns, chars", [(2048, 1 << 22), (3, 1 << 22), (50, 40)])
def test_long_conversations_in_blocks(spark, monkeypatch, turns, chars):
    """A hot conversation, ties, repeated rows, nulls and very long texts over many partitions and blocks."""
    monkeypatch.setattr(cr, "BLOCK_TURNS", turns)
    monkeypatch.setattr(cr, "BLOCK_CHARS", chars)
    rng = random.Random(turns)
    texts = ["yes.", "no!", "why?", "hm", " ", "", None, "long " * 20_000 + "."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None]
    rows = [(7, rng.choice([None, *range(900)]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.3 else f"text {k}.") for k in range(1500)]
    rows += [(c, t, rng.choice(roles[:4]), f"{c} {t} " + rng.choice(["a.", "b"])) for c in (None, 1, 2, 8, 9) for t in range(rng.randrange(1, 9))]
    rows += [(3, 1, "user", "same.")] * 40
    df = spark.createDataFrame(odd_rows(rows), SCHEMA).repartition(5)
    assert result(cr.repaired_damage(df)) == plain(rows)


def test_turns_are_given_in_full(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "user", "  "), (1, 3, "user", "How?"), (2, 0, "user", "Alone.")]
    found = cr.repair(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))
    got = [tuple(r) for r in found.turns().orderBy("conv_id", "at", "position").select("conv_id", "edit", "role", "text").collect()]
    by = {c: [r[1:] for r in g] for c, g in groupby(got, key=lambda r: r[0])}
    assert by == {1: [("K", "system", "Be kind."), ("R", "user", "Hello."), ("D", "user", "  "), ("R", "assistant", "How?")], 2: [("D", "user", "Alone.")]}


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert cr.repaired_damage(empty).collect() == [] and cr.repair(empty).turns().collect() == []
