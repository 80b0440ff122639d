"""Repair of conversations by error-correcting Earley parsing.

A repaired conversation reads `(s?(ua)+)?`: at most one system turn, then pairs of a user's and an assistant's turn, or nothing at all. The
weighted grammar is left-linear, a nonterminal for each kind of beginning:

    Talk   -> Open | Pairs
    Open   -> (nothing) | Open delete
    System -> Open system | System delete
    User   -> Open user | System user | Pairs user | User delete
    Pairs  -> User assistant | Pairs delete

    system -> keep s             user, assistant -> keep u or a | rerole any turn | insert        delete -> delete any turn

So every Earley item begins at the conversation's start, and "head -> Open . user" is in a chart set just when Open is complete there: a chart set is kept as
the complete nonterminals, each with its least (cost, audit). Scanning takes a turn by a keep, rerole or delete production; insert productions
are empty and are completed within their set. Audits hold a letter for each edit. Of two audits of equal cost for the same turns none begins the other
(the longer one would have paid for more inserts), so that what is least for a beginning stays least whatever follows.

Conversations can have any number of turns. The turns are dealt out by range of (conversation, turn, ...) and read as a stream of
blocks. A conversation within one block is parsed at once. Of others, each block is parsed from each of the four nonterminals;
a fold over these small tables finds the way through the blocks, and each block's part of the audit goes back to its turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, stored, stream

#: What edits cost, and what a truncated turn that isn't deleted adds.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

#: Turns and characters of a block at most (a longer turn is a block of its own).
BLOCK_TURNS, BLOCK_CHARS = 2048, 1 << 22

#: For each nonterminal the terminals that may follow it, each with the nonterminal that is complete then.
AFTER: dict[str, tuple[tuple[str, str], ...]] = {
    "Open": (("s", "System"), ("u", "User")),
    "System": (("u", "User"),),
    "User": (("a", "Pairs"),),
    "Pairs": (("u", "User"),),
}
NAMES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")

#: A chart set: complete nonterminals with their least (cost, audit).
Chart = dict[str, tuple[int, str]]


def _offer(chart: Chart, head: str, cost: int, audit: str) -> bool:
    if head in chart and chart[head] <= (cost, audit):
        return False
    chart[head] = cost, audit
    return True


def completed(chart: Chart) -> Chart:
    """With the insert productions, which take no turn: until no item gets less."""
    todo = list(chart)
    while todo:
        head = todo.pop()
        cost, audit = chart[head]
        todo += [to for symbol, to in AFTER[head] if symbol in NAMES and _offer(chart, to, cost + INSERT, audit + "I")]
    return chart


def scanned(chart: Chart, initial: str, fault: str) -> Chart:
    """The next chart set, after a turn. fault: b(lank), d(uplicate), t(runcated) or a minus sign."""
    out: Chart = {}
    more = TRUNCATED if fault == "t" else 0
    for head, (cost, audit) in chart.items():
        _offer(out, head, cost + DELETE, audit + "D")
        if fault not in "bd":
            for symbol, to in AFTER[head]:
                if symbol == initial:
                    _offer(out, to, cost + more, audit + "K")
                elif symbol in NAMES:
                    _offer(out, to, cost + more + REROLE, audit + "R")
    return completed(out)


def parse(turns: Iterable[tuple[str, str]], start: str = "Open") -> Chart:
    """The last chart set for turns (initial, fault) read after a beginning that is complete as `start`."""
    chart = completed({start: (0, "")})
    for initial, fault in turns:
        chart = scanned(chart, initial, fault)
    return chart


def accepted(chart: Chart) -> tuple[int, str]:
    """Least (cost, audit) of Talk."""
    return min(chart[head] for head in ("Open", "Pairs") if head in chart)


def edited(audit: str, turns: Iterable[tuple[str, str]], state: str = "Open") -> Iterator[tuple[str, str | None, str | None]]:
    """(edit, role, text) for each letter of an audit over turns (role, text); a deleted turn's own role and text."""
    rest = iter(turns)
    for letter in audit:
        role, text = (None, "") if letter == "I" else next(rest)
        if letter != "D":
            symbol = role[:1] if letter == "K" else "a" if state == "User" else "u"
            role = role if letter == "K" else NAMES[symbol]
            state = dict(AFTER[state])[symbol]
        yield letter, role, text


def state_after(audit: str, initials: Iterable[str], state: str) -> str:
    for letter, role, _ in edited(audit, ((c, "") for c in initials), state):
        if letter != "D":
            state = dict(AFTER[state])[role[:1]]
    return state


def with_faults(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text, id) with fault, and digest (of the text).

    A turn is a duplicate if its role and text are in the conversation earlier, where turns are in the order of (turn, role, digest, id), nulls
    first. Only what occurs more than once is joined, and only its first place.
    """
    rows = rows.withColumn("digest", F.sha2("text", 256))
    key = ["conv_id", "role", "digest"]
    place = F.struct("turn", "id")
    again = stored(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1").select(*(F.col(c).alias(f"of_{c}") for c in key), "first"), "again")
    same = F.col("conv_id").eqNullSafe(F.col("of_conv_id")) & (F.col("role") == F.col("of_role")) & (F.col("digest") == F.col("of_digest"))
    fault = (
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "b")
        .when(F.col("first").isNotNull() & (F.col("first") < place), "d")
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "t")
        .otherwise("-")
    )
    return rows.join(again, same, "left").select("conv_id", "turn", "role", "text", "id", "digest", fault.alias("fault"))


#: What is known of a run of turns and adds up over runs.
COUNTS = ("blank", "duplicate", "truncated", "illegal")


def measured(turns: list[int | None], initials: list[str], faults: str) -> dict:
    known = [t for t in turns if t is not None]
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
    return {"low": min(known, default=None), "high": max(known, default=None), "distinct": len(set(known)), "first": initials[0], "last": initials[-1]} | dict(
        zip(COUNTS, (faults.count("b"), faults.count("d"), faults.count("t"), illegal), strict=True)
    )


def joined(a: dict | None, b: dict) -> dict:
    """Of a run and the run that follows it. Turns are in order, so that the two share at most the turn where they meet."""
    if a is None:
        return b
    out = {c: a[c] + b[c] for c in COUNTS}
    out["illegal"] += a["last"] + b["first"] not in LEGAL
    meet = a["high"] is not None and a["high"] == b["low"]
    low, high = (a["low"] if a["low"] is not None else b["low"]), (b["high"] if b["high"] is not None else a["high"])
    return out | {"low": low, "high": high, "distinct": a["distinct"] + b["distinct"] - meet, "first": a["first"], "last": b["last"]}


def finished(run: dict, cost: int, audit: str) -> dict:
    gaps = 0 if run["low"] is None else run["high"] - run["low"] + 1 - run["distinct"]
    return {"gaps": gaps, **{c: run[c] for c in COUNTS}, "cost": cost, "audit": audit}


TOTAL = "total struct<gaps:long,blank:long,duplicate:long,truncated:long,illegal:long,cost:long,audit:string>"
RUN = "run struct<low:long,high:long,distinct:long,first:string,last:string,blank:long,duplicate:long,truncated:long,illegal:long>"
WAYS = "ways array<struct<start:string,stop:string,cost:long,audit:string>>"


def _size(row: dict) -> int:
    return sum(map(len, row.get("texts") or ()))


def _blocks(rows: Iterator[dict]) -> Iterator[list[dict]]:
    """The rows of a conversation in runs of bounded size."""
    held, size = [], 0
    for row in rows:
        if held and (len(held) >= BLOCK_TURNS or size + len(row["text"]) > BLOCK_CHARS):
            yield held
            held, size = [], 0
        held.append(row)
        size += len(row["text"])
    yield held


def _parsed(rows: Iterator[dict]) -> Iterator[dict]:
    """Block records of a partition's sorted rows. Its first and last conversation may go on in other partitions: they stay open."""
    at = TaskContext.get().partitionId() << 32

    def record(block: list[dict]) -> dict:
        nonlocal at
        at += 1
        run = measured([r["turn"] for r in block], [r["role"][:1] for r in block], "".join(r["fault"] for r in block))
        return {"at": at, "conv_id": block[0]["conv_id"], "roles": [r["role"] for r in block], "texts": [r["text"] for r in block], "faults": "".join(r["fault"] for r in block), "run": run}

    def symbols(rec: dict) -> list[tuple[str, str]]:
        return [(role[:1], fault) for role, fault in zip(rec["roles"], rec["faults"], strict=True)]

    def whole(rec: dict) -> dict:
        return rec | {"total": finished(rec["run"], *accepted(parse(symbols(rec))))}

    def part(rec: dict) -> dict:
        ways = [(a, b, *found) for a in AFTER for b, found in parse(symbols(rec), a).items()]
        return rec | {"ways": [dict(zip(("start", "stop", "cost", "audit"), way, strict=True)) for way in ways]}

    waiting, first = None, True
    for _, turns in groupby(rows, key=lambda r: r["conv_id"]):
        if waiting is not None:
            yield (part if first else whole)(waiting)
            waiting, first = None, False
        blocks = _blocks(turns)
        waiting = record(next(blocks))
        for block in blocks:
            if waiting is not None:
                yield part(waiting)
                waiting, first = None, False
            yield part(record(block))
    if waiting is not None:
        yield part(waiting)


def _folded(rows: Iterator[dict]) -> Iterator[dict]:
    """For each block of an open conversation its piece of the audit and the state that it starts in; with the last block the totals."""
    for _, blocks in groupby(rows, key=lambda r: r["conv_id"]):
        chart, run, places = {"Open": (0, "")}, None, []
        for b in blocks:
            out: Chart = {}
            for way in b["ways"]:
                if way["start"] in chart:
                    cost, audit = chart[way["start"]]
                    _offer(out, way["stop"], cost + way["cost"], audit + way["audit"])
            chart, run = out, joined(run, b["run"])
            places.append((b["at"], b["initials"]))
        cost, audit = accepted(chart)
        state, taken = "Open", 0
        for k, (at, initials) in enumerate(places):
            last, end, left = k == len(places) - 1, taken, len(initials)
            while left:
                left -= audit[end] != "I"
                end += 1
            end = len(audit) if last else end
            yield {"of": at, "state": state, "piece": audit[taken:end], "total": finished(run, cost, audit) if last else None}
            state, taken = state_after(audit[taken:end], initials, state), end


def _edits(rows: Iterator[dict]) -> Iterator[dict]:
    for b in rows:
        edits = list(edited(b["audit"], zip(b["roles"], b["texts"], strict=True), b["state"]))
        yield {"conv_id": b["conv_id"], "at": b["at"], "whole": b["whole"], "edits": b["audit"], "roles": [e[1] for e in edits], "texts": [e[2] for e in edits]}


def _hashed(rows: Iterator[dict]) -> Iterator[dict]:
    """(conv_id, total, repaired_sha256) of pieces in order, a conversation's after each other."""
    for (conv, _), pieces in groupby(rows, key=lambda r: (r["conv_id"], r["whole"] and r["at"])):
        digest, between, total = hashlib.sha256(), "", None
        for b in pieces:
            total = b["total"]
            for edit, role, text in edited(b["audit"], zip(b["roles"], b["texts"], strict=True), b["state"]):
                if edit != "D":
                    digest.update(f"{between}{role}:{text}".encode())
                    between = "\n"
        yield {"conv_id": conv, "total": total, "repaired_sha256": digest.hexdigest()}


class Repair:
    """What the parse found, as pieces (conv_id, at, whole, roles, texts, audit, state, total): a block of turns, its part of the audit and what is complete before it;
    the totals are with a conversation's last block.
    """

    def __init__(self, pieces: DataFrame) -> None:
        self.pieces = pieces
        self.of = f"conv_id {pieces.schema['conv_id'].dataType.simpleString()}"

    def conversations(self) -> DataFrame:
        """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), a row for each conversation that has turns."""
        return self.pieces.where("total is not null").select("conv_id", "total.*")

    def blocks(self) -> DataFrame:
        """(conv_id, at, whole, edits, roles, texts) in order of `at`: a letter, role and text for each edit, deleted turns included."""
        return stream(self.pieces.drop("total"), _edits, f"{self.of}, at long, whole boolean, edits string, roles array<string>, texts array<string>", size=_size)

    def turns(self) -> DataFrame:
        """(conv_id, at, position, edit, role, text): the edits one by one, in order of (at, position)."""
        each = F.posexplode(F.arrays_zip(F.split("edits", "").alias("edit"), "roles", "texts")).alias("position", "e")
        rows = self.blocks().where("edits <> ''").select("conv_id", "at", each)
        return rows.select("conv_id", "at", "position", "e.edit", F.col("e.roles").alias("role"), F.col("e.texts").alias("text"))

    def digests(self) -> DataFrame:
        """(conv_id, total, repaired_sha256): of `role:text` of the turns that stay, joined by newlines.

        A conversation of one block is hashed where it is. Of others the blocks are brought together in order and hashed as a stream: a hash of
        the whole can't be put together from parts, so that this takes a task, which holds one block at a time.
        """
        shape = f"{self.of}, {TOTAL}, repaired_sha256 string"
        open_ = self.pieces.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "at")
        return stream(self.pieces.where("whole"), _hashed, shape).unionByName(stream(open_, _hashed, shape))


def repair(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repair:
    """Repairs the conversations of rows.

    Turns of a conversation are in the order of (turn, role, hash of the text), nulls first; equal rows are turns of their own, the later ones
    duplicates. A null conv_id is a conversation too; a null role or text is one space. Roles other than user, assistant and system by
    their first letter can be reroled or deleted only. Other columns are left out. Empty table: no conversations.
    """
    spark = rows.sparkSession
    named = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))))
    kept = stored(named.withColumn("id", F.monotonically_increasing_id()), "turns")
    of = f"conv_id {named.schema['conv_id'].dataType.simpleString()}"
    order = ["conv_id", "turn", "role", "digest", "id"]
    dealt = with_faults(kept).repartitionByRange(*order).sortWithinPartitions(*order).drop("digest", "id")
    blocks = stored(stream(dealt, _parsed, f"at long, {of}, roles array<string>, texts array<string>, faults string, {RUN}, {TOTAL}, {WAYS}", size=_size), "blocks")
    drop(spark, kept)
    initials = F.transform("roles", lambda r: F.substring(r, 1, 1)).alias("initials")
    open_ = blocks.where("total is null").select("at", "conv_id", "run", "ways", initials)
    pieces = stored(stream(open_.repartition("conv_id").sortWithinPartitions("conv_id", "at"), _folded, f"of long, state string, piece string, {TOTAL}"), "pieces")
    columns = ["conv_id", "at", "whole", "roles", "texts", "audit", "state", "total"]
    whole = blocks.where("total is not null").withColumns({"whole": F.lit(True), "audit": F.col("total.audit"), "state": F.lit("Open")})
    rest = blocks.where("total is null").select("at", "conv_id", "roles", "texts").join(pieces.select(F.col("of").alias("at"), F.col("piece").alias("audit"), "state", "total"), "at")
    return Repair(whole.select(columns).unionByName(rest.withColumn("whole", F.lit(False)).select(columns)))


def damaged(rows: DataFrame) -> DataFrame:
    """The rows that the query repairs: by crc32(`conv_id:turn`) % 20 a row is left out (0), loses its text (1) or its full stops (2), is there twice (3) or gets the role user (4)."""
    space = F.lit(" ")
    kind = F.crc32(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn"))).cast("binary")) % 20
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    out = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return out.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def repaired_damage(conversations: DataFrame) -> DataFrame:
    """What op11 returns: a row for each conv_id of conversations, also of those that the damage has left no turn."""
    found = repair(damaged(conversations))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    there = found.digests().select("conv_id", *(f"total.{c}" for c in counts), "total.audit", "repaired_sha256")
    left = found.pieces.select(F.col("conv_id").alias("left_id"))
    gone = conversations.select("conv_id").distinct().join(left, F.col("conv_id").eqNullSafe(F.col("left_id")), "left_anti")
    return there.unionByName(gone.select("conv_id", *(F.lit(0).cast("long").alias(c) for c in counts), F.lit("").alias("audit"), F.sha2(F.lit(""), 256).alias("repaired_sha256")))


def _sql() -> str:
    add = lambda state, cost, letter: f"(lpad(CAST(CAST({state}[1:10] AS BIGINT) + {cost} AS VARCHAR), 10, '0') || {state}[11:] || '{letter}')"
    more = "CASE WHEN fault = 't' THEN 5 ELSE 0 END"
    free = "fault NOT IN ('b', 'd')"
    role = lambda state, c: f"CASE WHEN {free} THEN CASE WHEN initial = '{c}' THEN {add(state, more, 'K')} ELSE {add(state, f'1 + {more}', 'R')} END END"
    user = f"least(u, {add('o', 5, 'I')}, {add('s', 5, 'I')}, {add('p', 5, 'I')})"
    return f"""
WITH RECURSIVE dealt AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
kinds AS (
  SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(k, ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda x, y: list_reduce(list_concat([xor(x, y)], [CAST(1 AS BIGINT), 1, 1, 1, 1, 1, 1, 1]), lambda v, w: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END)))) % 20 AS kind
  FROM dealt),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copies(n)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, role[1:1] AS initial FROM damaged),
faulty AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '-' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM faulty GROUP BY conv_id),
chart AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, '0000000000' AS o, CAST(NULL AS VARCHAR) AS s, '0000000005I' AS u, '0000000010II' AS p FROM counts
  UNION ALL
  SELECT conv_id, i, o, s, u, least(p, {add("u", 5, "I")}) AS p FROM (
    SELECT conv_id, i, o, s, {user} AS u, p FROM (
      SELECT c.conv_id, f.i, {add("o", 2, "D")} AS o, least({add("s", 2, "D")}, CASE WHEN {free} AND initial = 's' THEN {add("o", more, "K")} END) AS s,
        least({add("u", 2, "D")}, {role("o", "u")}, {role("s", "u")}, {role("p", "u")}) AS u, least({add("p", 2, "D")}, {role("u", "a")}) AS p
      FROM chart c JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM c.conv_id AND f.i = c.i + 1) scanned) inserted),
best AS (SELECT c.conv_id, least(o, p) AS talk FROM chart c JOIN counts n ON n.conv_id IS NOT DISTINCT FROM c.conv_id AND c.i = n.n),
letters AS (
  SELECT conv_id, j, talk[10 + j:10 + j] AS letter FROM best, unnest(range(1, len(talk) - 9)) AS places(j)),
numbered AS (
  SELECT *, count(*) FILTER (letter <> 'I') OVER w AS i, count(*) FILTER (letter <> 'D') OVER w AS kept FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
edits AS (
  SELECT n.*, f.role, f.initial, CASE WHEN letter = 'I' THEN '' ELSE f.text END AS text FROM numbered n LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM n.conv_id AND f.i = n.i AND n.letter <> 'I' WHERE letter <> 'D'),
opened AS (SELECT *, max(CASE WHEN kept = 1 AND letter = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS lead FROM edits),
repaired AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (kept - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j)) AS repaired_sha256 FROM opened GROUP BY conv_id)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(CAST(talk[1:10] AS BIGINT), 0) AS cost, coalesce(talk[11:], '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM d.conv_id
  LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM d.conv_id"""


SQL = _sql()
