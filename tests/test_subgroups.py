"""Beam search on bitmaps against a plain one in memory."""

import random

import pytest

from cohortlens.functions.dist import fisher_greater
from cohortlens.operators import subgroups


def plain(rows, xs, beam, support, depth, alpha):
    """Every extension counted row by row."""
    total, classes = len(rows), sorted({r["y"] for r in rows})
    size = {t: sum(r["y"] == t for r in rows) for t in classes}
    items = sorted({((x, r[x]),) for r in rows for x in xs}, key=lambda i: (xs.index(i[0][0]), i[0][1]))
    beams, out = {t: [()] for t in classes}, set()
    for level in range(1, depth + 1):
        for t in classes:
            scored = {}
            for parent in beams[t]:
                for (item,) in items:
                    if item[0] in {c for c, _ in parent}:
                        continue
                    rule = tuple(sorted((*parent, item), key=lambda c: xs.index(c[0])))
                    covered = [r for r in rows if all(r[c] == v for c, v in rule)]
                    pos = sum(r["y"] == t for r in covered)
                    if len(covered) >= support * total and pos:
                        scored[rule] = (pos / len(covered) / (size[t] / total), pos, len(covered))
            text = {r: [f"{c}={v}" for c, v in r] for r in scored}
            beams[t] = sorted(scored, key=lambda r: (-scored[r][0], -scored[r][1], text[r]))[:beam]
            for r in beams[t]:
                lift, pos, cov = scored[r]
                if lift > 1 and fisher_greater(pos, cov, size[t], total) <= alpha:
                    out.add((f"y={t}", ", ".join(text[r]), level, cov, pos))
    return out


def table(spark, n, variables, seed=2):
    rng = random.Random(seed)
    xs = [f"x{i}" for i in range(variables)]
    rows = []
    for _ in range(n):
        r = {x: rng.choice("abc") for x in xs}
        hit = r["x1"] == "a" and r["x2"] == "b" and r["x3"] != "c"
        r["y"] = "hit" if rng.random() < (0.9 if hit else 0.2) else rng.choice(["miss", "other"])
        rows.append(r)
    return rows, xs, spark.createDataFrame([tuple(r[c] for c in ("y", *xs)) for r in rows], ", ".join(f"{c} string" for c in ("y", *xs))).repartition(5)


@pytest.mark.parametrize(("beam", "support", "depth", "chunk"), [(3, 0.02, 3, 4096), (10, 0.0, 2, 7), (1, 0.1, 4, 4096), (100, 0.05, 3, 50)])
def test_same_rules_as_a_full_search(spark, monkeypatch, beam, support, depth, chunk):
    """Also when the rules are counted a few at a time, so that bounds end the counting early."""
    monkeypatch.setattr(subgroups, "CHUNK_RULES", chunk)
    rows, xs, df = table(spark, 500, 5)
    found = subgroups.subgroups(df, "y", xs, beam=beam, support=support, depth=depth, alpha=0.2).collect()
    assert {(r["target"], r["rule"], r["depth"], r["cov"], r["pos"]) for r in found} == plain(rows, xs, beam, support, depth, 0.2)


def test_bounds_spare_counting(spark, monkeypatch):
    """Where the support is large, parts with few positives cannot make a good rule and are not counted."""
    counted, rng, xs = [], random.Random(3), [f"x{i}" for i in range(12)]
    rows = []
    for _ in range(800):
        r = [rng.choice("ab") for _ in xs]
        rows.append(("hit" if rng.random() < (0.9 if r[1] == "a" and r[2] == "b" else 0.05) else "miss", *r))
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in ("y", *xs)))
    real = subgroups._counts
    monkeypatch.setattr(subgroups, "_counts", lambda b, rules, *a: counted.append(len(rules)) or real(b, rules, *a))
    found = []
    for chunk in (10, 10**6):
        monkeypatch.setattr(subgroups, "CHUNK_RULES", chunk)
        found.append(subgroups.subgroups(df.filter("y = 'hit' OR x1 = 'b' OR x2 = 'a'"), "y", xs, beam=1, support=0.2, depth=2).collect())
    assert found[0] == found[1] and sum(counted[:-1]) < counted[-1]


def test_forty_covariables_at_depth_three(spark):
    """The planted rule is found although hardly two rows share all their categories."""
    rows, xs, df = table(spark, 4000, 40)
    best = subgroups.subgroups(df, "y", xs, beam=10, support=0.02, depth=3).filter("target = 'y=hit' AND depth = 3").orderBy("lift", ascending=False).first()
    assert "x1=a, x2=b" in best["rule"] and best["prec"] > 0.8


def test_nulls_and_empty_blocks(spark):
    df = spark.createDataFrame([("p", "a", "u"), ("q", "a", None), (None, "b", "u"), ("p", "a", "u"), ("q", "b", "v")], "y string, x string, z string").repartition(8)
    found = subgroups.subgroups(df, "y", ["x", "z"], support=0.0, alpha=1.0).collect()
    assert {(r["target"], r["rule"], r["cov"], r["pos"]) for r in found} == {
        ("y=p", "x=a", 2, 2), ("y=p", "z=u", 2, 2), ("y=p", "x=a, z=u", 2, 2), ("y=q", "x=b", 1, 1), ("y=q", "z=v", 1, 1), ("y=q", "x=b, z=v", 1, 1)}
