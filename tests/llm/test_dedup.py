import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import cosine_dedup, line_dedup, minhash_hamming
from palimpsest.llm.components import components
from palimpsest.llm.minhash_hamming import Plan
from tests.llm import brute


def answers(df, percent):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash_hamming.near_duplicates(df, percent=percent).collect())


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(spark, corpus, percent):
    df = spark.createDataFrame([(i, t, "clash") for i, t in corpus], "doc_id long, text string, component_id string")
    assert answers(df, percent) == sorted(brute.near_duplicates(corpus, percent))


def test_near_duplicates_in_blocks_and_rounds(spark, corpus, monkeypatch):
    """Blocks of two, and components too large for one task."""
    monkeypatch.setattr("palimpsest.llm._blocks.BLOCK", 2)
    monkeypatch.setattr(minhash_hamming.components, "__defaults__", (0,))
    rows = corpus[:60]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert answers(df, 85) == sorted(brute.near_duplicates(rows, 85))


def test_near_duplicates_of_repeated_ids(spark, corpus):
    rows = [(i % 23, t) for i, t in corpus] + [(3, None), (99, ""), (99, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert answers(df, 85) == sorted(brute.near_duplicates(rows, 85))
    a, b = (" ".join(f"{c}{k}" for k in range(50)) for c in "ab")
    df = spark.createDataFrame([(3, b), (5, b), (5, a), (7, a)], "doc_id long, text string")
    assert [r[2] for r in answers(df, 85)] == [3, 3, 3, 3]


def test_deduplicated_keeps_a_text_of_each_group(spark, corpus):
    a, b = (" ".join(f"{c}{k}" for k in range(50)) for c in "ab")
    rows = [(3, b, 1), (5, b, 2), (5, a, 3), (7, a, 4), (5, a, 3), (5, a, 3), (None, a, 5), (8, None, 6), (8, None, 6), (9, " ", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __id int")
    got = sorted((tuple(r) for r in minhash_hamming.deduplicated(df).collect()), key=str)
    assert got == sorted([(3, b, 1), (5, a, 3), (None, a, 5), (8, None, 6), (8, None, 6), (9, " ", 7)], key=str)
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    root = brute.near_duplicates(corpus, 80)
    assert {r.doc_id for r in minhash_hamming.deduplicated(df).collect()} == {i for i, _, c in root if i == c}
    assert minhash_hamming.deduplicated(df.where("false")).collect() == []


def test_a_large_group_of_near_copies(spark):
    """5,000 near copies of one text, some only near some others, against all pairs by matrix products."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 3000, 80)
    rows = []
    for k in range(5000):
        w = base.copy()
        for at in rng.integers(0, 80, rng.choice([1, 1, 2, 3])):
            w[at] = rng.integers(0, 3000)
        rows.append((k, " ".join(f"w{x}" for x in w)))
    sets = [brute.shingles(t) for _, t in rows]
    number = {}
    at = [(r, number.setdefault(s, len(number))) for r, ss in enumerate(sets) for s in ss]
    uses = np.bincount([c for _, c in at])
    shared = np.cumsum(uses > 1) - 1
    m = np.zeros((len(rows), int(shared[-1]) + 1), np.float32)
    for r, c in at:
        if uses[c] > 1:
            m[r, shared[c]] = 1
    size = np.array([len(s) for s in sets])
    both = m @ m.T
    x, y = np.nonzero(100 * both >= 85 * (size[:, None] + size[None, :] - both))
    root = brute.components(range(len(rows)), [(a, b) for a, b in zip(x.tolist(), y.tolist()) if a < b])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert answers(df, 85) == [(k, len(sets[k]), root[k]) for k in range(len(rows))]
    assert len(set(root.values())) > 1


def test_near_duplicates_defined_cases(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in minhash_hamming.near_duplicates(df).collect()), key=str)
    assert got == [(0, 2, None, True), (1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True)]
    assert minhash_hamming.near_duplicates(df.where("false")).collect() == []


def test_pigeonhole_guarantees_the_distance():
    plan = Plan.of(85)
    rng = random.Random(2)
    for _ in range(300):
        wrong = set(rng.sample(range(minhash_hamming.K), plan.max_diff))
        assert any(not wrong & set(s.tolist()) for s in plan.subsets)
    assert Plan.of(80).max_diff > plan.max_diff


def test_components(spark):
    rng = random.Random(3)
    links = [(0, k) for k in range(1, 40)] + [(k, k + 1) for k in range(100, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)] + [(7, 7), (1, 0)]
    df = spark.createDataFrame([*links, (None, 3)], "a long, b long")
    ids = {i for link in links if link[0] != link[1] for i in link}
    for one_task in (0, 1_000_000):
        got = {r.id: r.component for r in components(df, one_task).collect()}
        assert got == {i: c for i, c in brute.components(ids, links[:-2]).items()}
        assert components(df.where("false"), one_task).collect() == []


def test_lines(spark):
    ad = "Subscribe to our newsletter now"
    rows = [(k, f"own line number {k}\n \t{ad}\r\nend {k}", f"s{k % 9}", 1) for k in range(18)]
    rows += [(50 + k, f"nearly everywhere line\nrest {k}", f"s{k}", 1) for k in range(7)]  # a site short
    rows += [(70, None, "s1", 1), (71, "", None, 1), (72, ad, None, 1), (73, ad + "\n" + ad, "s1", 1), (0, rows[0][1], "s0", 1), (None, ad + "\nx", "s2", 1), (74, "short\n" * 30_000 + ad, "s3", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_removed int")
    got = sorted(((r.doc_id, r.text, r.n_removed) for r in line_dedup.remove_boilerplate(df).collect()), key=lambda r: (r[0] is None, r[0] or 0))
    want = sorted(((i, None if t is None else "\n".join(x for x in t.split("\n") if x.strip(" \t\r") != ad), sum(x.strip(" \t\r") == ad for x in (t or "").split("\n"))) for i, t, _, _ in rows), key=lambda r: (r[0] is None, r[0] or 0))
    assert got == want
    assert line_dedup.remove_boilerplate(df.where("false")).collect() == []


def test_lines_with_clashing_columns_and_short_ones(spark):
    rows = [(k, "x\nLes.\n\nend", f"s{k}", "own", k) for k in range(9)] + [(99, "\n".join(f"line {k}\nLes." for k in range(30_000)), "s1", "own", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, __cut string, __K1 long")
    assert all(r.n_removed == 0 and r["__cut"] == "own" for r in line_dedup.remove_boilerplate(df).collect())
    got = {r.doc_id: r for r in line_dedup.remove_boilerplate(df, min_chars=1).collect()}
    assert all((got[k].text, got[k].n_removed, got[k]["__cut"], got[k]["__K1"]) == ("", 3, "own", k) for k in range(9))
    assert got[99].text == "\n".join(f"line {k}" for k in range(30_000)) and got[99].n_removed == 30_000


def test_line_counts_are_exact_near_the_threshold(spark):
    rows = [(h, 0, f"s{k}") for h in range(200) for k in range(100 - h % 40 + 20)]
    df = spark.createDataFrame(rows, "h1 long, h2 long, site string")
    got = {r.h1 for r in line_dedup.boilerplate(df, min_sites=100, lg_k=6).collect()}
    assert got == {h for h in range(200) if 120 - h % 40 >= 100}


def vectors():
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 16))
    rows = [b for b in base]
    for k in range(160):
        rows.append(base[k % 12] + rng.standard_normal(16) * rng.choice([0.05, 0.2, 0.3, 0.4]))
    out = [(i, [float(x) for x in np.float32(r)]) for i, r in enumerate(rows)]
    n = len(out)
    odd = [out[0][1], out[0][1], [2 * x for x in out[1][1]], None, [], [0.0] * 16, [math.nan] + [1.0] * 15, [math.inf] + [1.0] * 15, [None] + [1.0] * 15, out[0][1][:8], out[0][1][:8]]
    return out + [(n + k, v) for k, v in enumerate(odd)]


@pytest.mark.parametrize("home", [1, 40, cosine_dedup.HOME])
def test_vectors(spark, monkeypatch, home):
    monkeypatch.setattr(cosine_dedup, "BLOCK", 16)
    monkeypatch.setattr(cosine_dedup, "HOME", home)
    rows = vectors()
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, kept int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in cosine_dedup.near_duplicates(df).collect()}
    good = {i: np.array(v) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    pairs = [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= 0.95]
    root = brute.components([i for i, _ in rows], pairs)
    assert got == {i: (sum(i in p for p in pairs), root[i], root[i] == i) for i, _ in rows}


def test_vectors_defined_cases(spark):
    for kind in ("float", "double"):
        far = [(1, [1.0, 2.0, 3.0]), (2, [1e200, 2e200, 3e200]), (3, [1e-200, 2e-200, 3e-200])] if kind == "double" else [(1, [1.0, 2.0, 3.0]), (2, [1e38, 2e38, 3e38]), (3, [1e-38, 2e-38, 3e-38])]
        df = spark.createDataFrame(far, f"vec_id long, embedding array<{kind}>")
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in cosine_dedup.near_duplicates(df).collect()) == [(1, 2, 1), (2, 2, 1), (3, 2, 1)]
    df = spark.createDataFrame([(None, [1.0, 0.0]), (5, [1.0, 0.0]), (5, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id) for r in cosine_dedup.near_duplicates(df).collect()), key=str)
    assert got == [(0, 0, None), (5, 1, 5), (5, 1, 5)]
    assert cosine_dedup.near_duplicates(df.where("false")).collect() == []
