from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from graphloom.llm import conversations as C
from graphloom.llm import queries

SHAPE = re.compile(r"(s?(ua)+)?\Z")
SPACE = " \t\n\v\f\r"


def all_repairs(initials, faults, most):
    """Every string of edits up to a cost, with the cost and the initials it gives: no state, no bound."""

    def go(at, cost, audit, made):
        if cost > most:
            return
        if at == len(initials) and SHAPE.match(made):
            yield cost, audit
        for new in "ua":
            yield from go(at, cost + 2, audit + "I", made + new)
        if at < len(initials):
            yield from go(at + 1, cost + 3, audit + "D", made)
            if faults[at] not in "bd":
                extra = faults[at] == "t"
                yield from go(at + 1, cost + extra, audit + "K", made + initials[at])
                for new in "ua":
                    yield from go(at + 1, cost + 2 + extra, audit + "R", made + new)

    return go(0, 0, "", "")


def test_search_equals_all_repairs():
    rng = random.Random(5)
    for _ in range(250):
        n = rng.randrange(4)
        initials = "".join(rng.choice("suaax ") for _ in range(n))
        faults = "".join(rng.choice("--bdt") for _ in range(n))
        cost, audit, _ = C.search(initials, faults)
        assert (cost, audit) == min(all_repairs(initials, faults, cost)), (initials, faults)


def forward(initials, faults):
    """The least (cost, audit) by keeping the best prefix of each last role, row after row."""
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}

    def put(labels, last, prefix):
        if last not in labels or prefix < labels[last]:
            labels[last] = prefix

    def filled(labels):
        for _ in range(4):
            for last, (cost, audit) in list(labels.items()):
                put(labels, follows[last][-1], (cost + 2, audit + "I"))
        return labels

    labels = filled({"": (0, "")})
    for initial, fault in zip(initials, faults, strict=True):
        after = {}
        for last, (cost, audit) in labels.items():
            put(after, last, (cost + 3, audit + "D"))
            if fault not in "bd":
                put(after, follows[last][-1], (cost + 2 + (fault == "t"), audit + "R"))
                if initial in follows[last]:
                    put(after, initial, (cost + (fault == "t"), audit + "K"))
        labels = filled(after)
    return min(labels[x] for x in ("", "a") if x in labels)


def test_search_equals_forward_labels_on_long_ones():
    rng = random.Random(6)
    for n in [*range(30), 100, 400, 1500]:
        initials = "".join(rng.choice("suaauaux") for _ in range(n))
        faults = "".join(rng.choice("----bdt") for _ in range(n))
        cost, audit, looked = C.search(initials, faults)
        assert (cost, audit) == forward(initials, faults)
        assert looked <= 8 * (n + 2)


def plain(rows):
    """The whole contract, a row at a time."""
    groups = {}
    for conv_id, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        groups.setdefault(conv_id, []).extend([(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    out = {}
    for conv_id, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), ""
        for _, role, text in own:
            bare = text.strip(SPACE)
            faults += "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "-"
            seen.add((role, text))
        initials = "".join(r[1][:1] or " " for r in own)
        cost, audit = forward(initials, faults)
        made, at, last = [], 0, ""
        for edit in audit:
            new = {"": "u", "s": "u", "u": "a", "a": "u"}[last]
            if edit == "D":
                at += 1
                continue
            turn_of = {"u": "user", "a": "assistant"}
            if edit == "I":
                made.append((turn_of[new], ""))
            else:
                made.append((own[at][1] if edit == "K" else turn_of[new], own[at][2]))
                new = initials[at] if edit == "K" else new
                at += 1
            last = new
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        out[conv_id] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, digest)
    return out


def results(df):
    return {r["conv_id"]: tuple(r[c] for c in C.RESULT.names[1:]) for r in df.collect()}


@pytest.mark.parametrize("held", [C.HELD_BYTES, 300])
def test_query_equals_plain_model(spark, sf, held):
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    got = results(C.repaired(C.damaged(table), held))
    assert got == plain(rows) and len(got) == len({r[0] for r in rows})
    if held == C.HELD_BYTES:
        assert results(queries.op11_conversation_repair(spark, sf)) == got


@pytest.mark.parametrize("held", [C.HELD_BYTES, 0])
def test_odd_rows(spark, held):
    long = "w " * 200_000
    rows = [
        (None, None, None, None), (None, 1, "user", "a."), (None, None, "tool", "x."), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "assistant", "b."), (1, None, "system", "s."),
        (2, 0, "user", long), (2, 1, "assistant", long + "." + " " * 400), (3, 5, "", "  \t"), (3, 900, "assistant", "é!"), (4, 1, "umpire", " "), (4, 2, "a", "x?\n"),
        *[(9, k, "user", "again.") for k in range(60)], *[(10 + k, k, "user", "q?") for k in range(60)],
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("audit", "kind", "gone", "copy", "id")})
    got = results(C.repaired(C.damaged(df), held))
    assert got == plain(rows)
    dropped = [k for k in range(10, 70) if zlib.crc32(f"{k}:{k - 10}".encode()) % 20 == 0]
    assert dropped and all(got[k] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for k in dropped)
    assert C.repaired(C.damaged(df.limit(0))).count() == 0
