from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphloom.llm import hosts, queries
from tests.compare import difference, duck

RNG = random.Random(8)
WORDS = [f"w{k}" for k in range(400)]


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n)) + "."


ODD = [
    None, "", " \t\n", "a", prose(7), prose(8), prose(9), "x y " * 6, "a b c d e f g h " * 2, "a b c d e f g h a b c d e f g", "one " * 9, "one " * 8, "# $ % & | < > *\n#", "line\nline\nline \n\n\n line\nline",
    prose(30) + " " + "p q r s t u v w " + prose(20) + " p q r s t u v w", "é ü 日本 👍🏽 x", "a\vb\fc\rd\n", prose(3000) + "\n" + prose(3000), "\x85   x",
]


def figures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), sum(c in hosts.SYMBOLS for c in text), len(lines) - len(set(lines)), len(inside), len(lines)


def plain(rows, most):
    """Figures and verdicts, rule by rule and host by host."""
    held = [(d, h, figures(t)) for d, h, t in rows]
    rule = {
        "few_words": lambda f: f[0] < 20,
        "repeats": lambda f: 100 * f[4] > 30 * f[0],
        "symbols": lambda f: 10 * f[2] > f[0],
        "dup_lines": lambda f: 10 * f[3] > 3 * f[5],
        "short_words": lambda f: f[1] < 2 * f[0],
    }
    size = Counter(h for _, h, _ in held if h is not None)
    bad = {}
    for name, fails in rule.items():
        failed = Counter(h for _, h, f in held if h is not None and fails(f))
        total = sum(size.values())
        for h, n in size.items():
            rate = failed[h] / n
            if len(size) > 1:
                m = sum(failed.values()) / total
                e = (len(size) - 1) / total
                between = sum(failed[x] ** 2 / size[x] for x in size) / total - m * m
                below = m * (1 - m) * (1 - sum(x * x for x in size.values()) / total**2 - e)
                g = (between - m * (1 - m) * e) / below if below else 0
                rate = m if g <= 0 else rate if g >= 1 else (failed[h] + m * (1 - g) / g) / (n + (1 - g) / g)
            if rate > most:
                bad.setdefault(h, name)
    out = Counter()
    for d, h, f in held:
        base = rule["few_words"](f) or rule["repeats"](f)
        out[(d, *f[:5], base, not base and h not in bad, bad.get(h))] += 1
    return out


def results(df):
    return Counter(tuple(r[c] for c in ("doc_id", *hosts.FIGURES, "base_failed", "kept", "host_rule")) for r in df.collect())


def test_query_equals_plain_model_and_sql(spark, sf):
    got = queries.op12_host_rules(spark, sf)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text").collect()]
    assert results(got) == plain(rows, hosts.MOST)
    assert not difference(got, duck(sf), hosts.SQL)


@pytest.mark.parametrize("most", [0.5, 0.2, 0.02])
def test_hosts_of_every_kind(spark, most):
    rows = [(k, None, t) for k, t in enumerate(ODD)] + [(None, "tiny", ""), (None, "tiny", ""), (1, "one", prose(40))]
    for h, n, share in (("good", 300, 0.02), ("mixed", 120, 0.3), ("bad", 90, 0.8), ("rare", 3, 1), ("small", 2, 0), ("worst", 60, 0.97)):
        rows += [(len(rows) + k, h, prose(5) if RNG.random() < share else "Wie " + prose(40)) for k in range(n)]
        rows += [(len(rows) + k, h + "#", prose(40).replace(" ", "# ") if RNG.random() < share else prose(40)) for k in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = results(hosts.host_rules(df.withColumns({c: F.lit(1) for c in ("host", "n_words", "kept", "h", "w")}), most))
    assert got == plain([(d, h, t) for d, h, t in rows], most)
    if most == 0.5:
        assert {"few_words", "symbols", None} == {r[-1] for r in got}


def test_single_host_and_no_rows(spark):
    df = spark.createDataFrame([(1, "h", "few"), (2, "h", prose(40)), (3, None, prose(40))], "doc_id long, source string, text string")
    assert results(hosts.host_rules(df)) == plain([tuple(r) for r in df.collect()], 0.5)
    assert hosts.host_rules(df.limit(0)).count() == 0
    alike = spark.createDataFrame([(k, f"h{k % 3}", prose(30)) for k in range(9)], "doc_id long, source string, text string")
    assert all(r["kept"] for r in hosts.host_rules(alike).collect())
