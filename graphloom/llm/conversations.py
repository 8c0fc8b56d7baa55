"""Repair of damaged conversations by depth-first branch-and-bound.

A conversation's rows, in order, become a chain of choices: keep, rerole, delete, or insert
a turn before the next row.  A node is (rows read, what the last kept turn was); a prefix of
edits that leads to it costs something and has an audit, the initials of its edits.  The
search keeps an explicit stack and

* a lower bound of what the rest costs from each node, with the order of audits relaxed: four
  numbers a row, from the end backwards, so that no prefix is followed that only looks cheap;
* an incumbent, the least (cost, audit) of a complete repair so far;
* a dominance table: of two prefixes that lead to one node, the greater (cost, audit) goes.

It ends when the stack is empty, which proves the incumbent: no prefix is left that could
still lead to a smaller (cost, audit).

Spark shuffles the rows by conversation and sorts them; a task streams over them and holds
one conversation at a time, of which the search sees two characters a row.  Where the texts
of a conversation are more than ``held_bytes``, the task lets them go; a second job streams
that conversation's rows once more behind its audit and hashes them as they come.

Defined cases: null ids, turns, roles and texts count as one space, so rows with a null
``conv_id`` are one conversation, returned with a null id; rows of one turn go by role, then
text; a role other than s, u, a (by its first character) can't be kept; a conversation that
lost all rows has zeros, an empty audit and the hash of nothing; empty tables give no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import n_partitions, staged

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
#: Costs of the edits and of a truncated row that stays.
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
#: Bytes of text of one conversation that a task holds for its hash.
HELD_BYTES = 64 << 20
LEGAL = frozenset({"su", "ua", "au"})
#: What comes after nothing (0), system (1), user (2), assistant (3), and the role that a new turn has there.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FILLED = ("u", "u", "a", "u")
NAMES = {"u": "user", "a": "assistant"}
DONE = (0, 3)
WORD = re.compile(r"[^\x20\x09-\x0D]")
LAST = re.compile(r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\Z")


def bounds(initials: str, faults: str) -> list[tuple[int, int, int, int]]:
    """For the rows from each place on, and each state before them: the least that they cost, whatever the audit."""

    def inserted(at: list[int]) -> tuple[int, int, int, int]:
        user, assistant = min(at[2], at[3] + INSERT_COST), min(at[3], at[2] + INSERT_COST)
        return min(at[0], user + INSERT_COST), min(at[1], user + INSERT_COST), user, assistant

    never = 1 << 60
    out = [inserted([0, never, never, 0])]
    for initial, fault in zip(reversed(initials), reversed(faults), strict=True):
        after, at = out[-1], []
        for state in range(4):
            least = after[state] + DELETE_COST
            if fault not in "bd":
                own = TRUNCATED_COST * (fault == "t")
                least = min(least, own + REROLE_COST + after[NEXT[state][FILLED[state]]])
                if initial in NEXT[state]:
                    least = min(least, own + after[NEXT[state][initial]])
            at.append(least)
        out.append(inserted(at))
    return out[::-1]


def search(initials: str, faults: str) -> tuple[int, str, int]:
    """The cheapest repair: its cost, its audit (ties: ASCII-least), and how many prefixes were looked at.

    ``initials`` has a character for each row, ``faults`` its fault: b(lank), d(uplicate), t(runcated) or a dash.
    """
    rest, n = bounds(initials, faults), len(initials)
    best: tuple[int, str] | None = None
    seen: dict[tuple[int, int], tuple[int, str]] = {(0, 0): (0, "")}
    stack, looked = [(0, 0, 0, "")], 0
    while stack:
        at, state, cost, audit = stack.pop()
        looked += 1
        if seen[at, state] != (cost, audit) or (best and _worse(cost + rest[at][state], audit, best)):
            continue
        if at == n and state in DONE and (best is None or (cost, audit) < best):
            best = (cost, audit)
        steps = [(at, NEXT[state][FILLED[state]], cost + INSERT_COST, audit + INSERT)]
        if at < n:
            steps.append((at + 1, state, cost + DELETE_COST, audit + DELETE))
            if faults[at] not in "bd":
                own = cost + TRUNCATED_COST * (faults[at] == "t")
                steps.append((at + 1, NEXT[state][FILLED[state]], own + REROLE_COST, audit + REROLE))
                if initials[at] in NEXT[state]:
                    steps.append((at + 1, NEXT[state][initials[at]], own, audit + KEEP))
        live = []
        for step in steps:
            node, prefix = step[:2], step[2:]
            least = prefix[0] + rest[node[0]][node[1]]
            if (best is None or not _worse(least, prefix[1], best)) and (node not in seen or prefix < seen[node]):
                seen[node] = prefix
                live.append((least, prefix[1], step))
        stack.extend(step for _, _, step in sorted(live, reverse=True))  # the most promising is next
    return *best, looked


def _worse(least: int, audit: str, best: tuple[int, str]) -> bool:
    """Whether no end of a prefix with this audit, costing ``least`` or more, beats ``best``."""
    return least > best[0] or (least == best[0] and audit > best[1][: len(audit)])


def applied(audit: str):
    """The edits one by one: what each makes of its row (``None``: goes, ``''``: stays, else the new role), and whether it takes a row."""
    state = 0

    def step(edit: str, initial: str = "") -> tuple[str | None, bool]:
        nonlocal state
        if edit == DELETE:
            return None, True
        made = initial if edit == KEEP else FILLED[state]
        state = NEXT[state][made]
        return ("" if edit == KEEP else NAMES[made]), edit != INSERT

    return step


class Repaired:
    """The repaired conversation's hash, as its rows come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.first = audit, 0, True
        self.step, self.hash = applied(audit), hashlib.sha256()

    def _turn(self, role: str, text: str) -> None:
        self.hash.update(("" if self.first else "\n").encode() + f"{role}:{text}".encode())
        self.first = False

    def _inserted(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == INSERT:
            self._turn(self.step(INSERT)[0], "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._inserted()
        made, _ = self.step(self.audit[self.at], role[:1])
        self.at += 1
        if made is not None:
            self._turn(made or role, text)

    def end(self) -> str:
        self._inserted()
        return self.hash.hexdigest()


class Conversation:
    """The rows of one conversation, in order."""

    def __init__(self, held_bytes: int):
        self.held_bytes, self.size = held_bytes, 0
        self.rows: list[tuple[str, str]] | None = []
        self.seen: set[bytes] = set()
        self.initials, self.faults, self.turns = [], [], [None, None, 0, None]

    def add(self, turn: int | None, role: str, text: str) -> None:
        key = hashlib.blake2b(f"{len(role)} {role}{text}".encode(), digest_size=16).digest()
        tail = LAST.search(text[-200:]) or LAST.search(text)
        fault = "b" if tail is None else "d" if key in self.seen else "-" if tail[1] in ".!?" else "t"
        self.seen.add(key)
        self.initials.append(role[:1] or " ")
        self.faults.append(fault)
        if turn is not None:
            low, _, n, last = self.turns
            self.turns = [turn if low is None else low, turn, n + (turn != last), turn]  # they come in order
        self.size += len(role) + len(text)
        if self.size > self.held_bytes:
            self.rows = None
        if self.rows is not None:
            self.rows.append((role, text))

    def result(self) -> dict:
        initials, faults = "".join(self.initials), "".join(self.faults)
        cost, audit, _ = search(initials, faults)
        low, high, n, _ = self.turns
        digest = None
        if self.rows is not None:
            out = Repaired(audit)
            for role, text in self.rows:
                out.row(role, text)
            digest = out.end()
        return {
            "gaps": 0 if low is None else high - low + 1 - n,
            "blank": faults.count("b"),
            "duplicate": faults.count("d"),
            "truncated": faults.count("t"),
            "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)),
            "cost": cost,
            "audit": audit,
            "repaired_sha256": digest,
        }


RESULT = pa.schema(
    [("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())]
)
RESULT_DDL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _emitted(found: list[dict]):
    yield pa.RecordBatch.from_pylist(found, RESULT)


def _repair(held_bytes: int):
    def run(batches):
        at, conversation, found = (), None, []
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone")]
            for conv_id, turn, role, text, gone in zip(*columns, strict=True):
                if (conv_id,) != at:
                    if conversation:
                        found.append({"conv_id": at[0]} | conversation.result())
                        if len(found) >= 1000:
                            yield from _emitted(found)
                            found = []
                    at, conversation = (conv_id,), Conversation(held_bytes)
                if not gone:
                    conversation.add(turn, role, text)
        if conversation:
            found.append({"conv_id": at[0]} | conversation.result())
        yield from _emitted(found)

    return run


def _hashed(batches):
    """Rows behind their conversation's audit: the hash of each conversation."""
    at, out, found = (), None, []
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "audit", "role", "text")]
        for conv_id, audit, role, text in zip(*columns, strict=True):
            if audit is not None:
                if out:
                    found.append((at[0], out.end()))
                at, out = (conv_id,), Repaired(audit)
            else:
                out.row(role, text)
    if out:
        found.append((at[0], out.end()))
    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in ((0, pa.int64()), (1, pa.string()))], ["conv_id", "sha"])


def spaced(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, gone``: the rows with faults put in by crc32(`conv_id:turn`) % 20; a dropped row stays, marked gone."""
    kind = F.crc32(F.concat(spaced(F.col("conv_id")), F.lit(":"), spaced(F.col("turn"))).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), spaced(F.col("role")).alias("role"), spaced(F.col("text")).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 3, 2).otherwise(1)
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), times.alias("times")
    ).select("conv_id", "turn", "role", "text", "gone", F.explode(F.sequence(F.lit(1), "times")).alias("copy")).drop("copy")


def _streamed(rows: DataFrame, *order: str) -> DataFrame:
    """Each conversation's rows in one partition, one after the other."""
    return rows.repartition(n_partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", *order)


def repaired(rows: DataFrame, held_bytes: int = HELD_BYTES) -> DataFrame:
    """One row per ``conv_id`` of ``rows`` (as from ``damaged``): faults, the cheapest edits and the hash of what they give."""
    found = staged(_streamed(rows, "turn", "role", "text").mapInArrow(_repair(held_bytes), RESULT_DDL), "repaired")
    long = found.where("repaired_sha256 IS NULL").select(F.col("conv_id").alias("id"), "audit")
    if long.isEmpty():
        return found
    held = rows.join(long.select("id"), rows["conv_id"].eqNullSafe(F.col("id")), "left_semi").where("NOT gone")
    behind = long.select(F.col("id").alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "audit")
    rest = held.select("conv_id", "turn", "role", "text", F.lit(None).cast("string").alias("audit"))
    ordered = _streamed(rest.unionByName(behind).withColumn("is_row", F.col("audit").isNull()), "is_row", "turn", "role", "text")
    hashes = ordered.mapInArrow(_hashed, "conv_id long, sha string").select(F.col("conv_id").alias("id"), "sha")
    full = found.join(hashes, found["conv_id"].eqNullSafe(F.col("id")), "left")
    return full.select(*[F.coalesce("repaired_sha256", "sha").alias(c) if c == "repaired_sha256" else F.col(c) for c in RESULT.names])
