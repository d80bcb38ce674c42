"""Awkward rows of the archive and decontamination operators, and the discriminant against plain numpy."""

import builtins
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from textbench.llm import components, decontaminate, quality, shared, warc

CLASHES = ("k", "h", "g", "at", "len", "w", "s", "n", "p", "m", "part__", "refers_to", "revisit", "items", "spans", "archive", "text_")


def clashing(df, *drop):
    return df.withColumns({c: F.lit("clash") for c in CLASHES if c not in drop})


def test_warc_awkward_pages(spark):
    long = "<p>" + "lorem é\r\n\r\n" * 60_000
    rows = [(1, "u v\r\nx", long), (2, None, long), (3, "", ""), (4, "u", None), (None, "u", ""), (None, None, None), (5, "u", "\r\n"), (5, "u", "\r\n"), (5, "w", "\r\n"), (-7, "é", "WARC/1.1\r\n"), (9, "u", "\x00\x01￿")]
    df = clashing(spark.createDataFrame(rows, "page_id long, url string, html string")).repartition(3)
    got = warc.archive_pages(df).collect()
    least = defaultdict(lambda: 1 << 62)
    for p, _, h in rows:
        least[h or ""] = min(least[h or ""], 1 << 62 if p is None else p)
    want = Counter()
    for p, _, h in rows:
        raw = (h or "").encode()
        mine = p is not None and p == least[h or ""]
        want[p, len(raw), warc.digest(raw), "response" if mine else "revisit", None if mine else least[h or ""]] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert {r.html for r in got if r.page_id == 1} == {long}


@pytest.mark.parametrize("share", [None, 1])
def test_decontamination_awkward_rows(spark, monkeypatch, share):
    word = lambda i: f"w{i}"
    passage = " ".join(map(word, range(12)))
    texts = [None, "", " ,.!", "W3", "w3", passage.upper(), f"x {passage} y", " ".join(f"q{i}" for i in range(200_000)) + " " + passage, "é" * 100_000, passage, passage]
    docs = [(i, t) for i, t in enumerate(texts)] + [(9, passage), (None, passage), (None, None)] + [(100 + i, passage) for i in range(40)]
    items = [(1, passage), (2, "w3"), (2, "w3"), (3, ""), (None, "w1"), (4, None), (5, " ".join(map(word, range(2, 12)))), (-6, "nowhere at all")]
    df = clashing(spark.createDataFrame(docs, "doc_id long, text string")).repartition(4)
    bench = clashing(spark.createDataFrame(items, "item_id long, text string"))
    if share:  # every key is hot
        monkeypatch.setattr(shared, "max", lambda *a: 1 if a[0] == 1000 else builtins.max(*a), raising=False)
    got = decontaminate.contamination(df, bench).select("doc_id", "n_words", F.size("spans").alias("n"), F.array_sort("items").alias("items")).collect()
    tokens = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower() if (t or "").isascii() else (t or ""))
    want = Counter()
    for d, t in docs:
        w, spans, who = tokens(t), set(), set()
        for item, x in items:
            y = tokens(x)
            for i in range(max(len(y) - 9, 1)):
                win = y[i : i + 10]
                for j in range(len(w) - len(win) + 1) if win and item is not None else ():
                    if w[j] == win[0] and w[j : j + len(win)] == win:
                        spans.add((j, len(win)))
                        who.add(item)
        want[d, len(w), len(spans), tuple(sorted(who))] += 1
    assert Counter((r.doc_id, r.n_words, r.n, tuple(r["items"])) for r in got) == want
    clean = decontaminate.contamination(df, bench.limit(0)).agg(F.sum(F.size("spans")), F.count("*")).first()
    assert tuple(clean) == (0, len(docs))


def test_discriminant_against_plain_formulas():
    rng = np.random.default_rng(6)
    x = [rng.normal(m, s, (n, 4)) @ rng.normal(0, 1, (4, 4)) for m, s, n in ((0, 1, 60), (1, 2, 90))]
    n, total, outer = np.array([60.0, 90.0]), np.stack([v.sum(0) for v in x]), np.stack([v.T @ v for v in x])
    pool, ridge = 0.3, 0.2
    model = quality.discriminant(n, total, outer, pool, ridge)
    covs = [np.cov(v.T, bias=True) for v in x]
    common = (60 * covs[0] + 90 * covs[1]) / 150
    z = rng.normal(0, 2, (20, 4))

    def log_density(c):
        s = (1 - ridge) * ((1 - pool) * covs[c] + pool * common) + ridge * (np.diag(np.diag(common)) + 1e-4 * np.eye(4))
        d = z - x[c].mean(0)
        return -0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) + np.log(np.linalg.det(s)))

    assert model.log_ratio(z) == pytest.approx(log_density(1) - log_density(0) + np.log(90 / 60), rel=1e-6)
    score = model.score(z)
    assert (np.diff(score[np.argsort(model.log_ratio(z))]) >= 0).all() and ((score >= 0) & (score <= 1)).all()


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(components, "HUB", 3)
    rng = np.random.default_rng(2)
    edges = [(0, i) for i in range(1, 60)] + [(500, i) for i in range(501, 540)] + [(int(a), int(b)) for a, b in rng.integers(600, 900, (150, 2))] + [(59, 58), (7, 7), (1000, 501)]
    parent = {}

    def root(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r.k, r.c) for r in got} == {(v, root(v)) for v in parent if root(v) != v} and len(got) == len({r.k for r in got})


def test_staged_tables_know_their_rows(spark):
    df = shared.staged(spark.range(10).withColumn("m", F.col("id")))
    assert shared.rows_of(df) == 10 and df.seen_when_staged["sum_m"] == 45 and df.seen_when_staged["max_m"] == 9
    assert shared.rows_of(shared.staged(spark.range(10).filter("id < 0"))) == 0 and shared.rows_of(spark.range(3)) == 3
