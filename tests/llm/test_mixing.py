"""Mixing: targets, cut, defined results of odd rows."""

import pytest

from cohortlens.llm import mixing

SCHEMA = "doc_id long, source string, size long"


def _mix(spark, rows, **options):
    return mixing.mix(spark.createDataFrame(rows, SCHEMA), **options).collect()


def _water(sizes, weights, share, epochs):
    """Share by weight, stop at the limit, share the rest again until nothing is above."""
    budget, capped = share * sum(sizes), set()
    while True:
        rest = budget - sum(epochs * sizes[i] for i in capped)
        w = sum(weights[i] for i in range(len(sizes)) if i not in capped)
        t = [epochs * s if i in capped else rest * weights[i] / w for i, s in enumerate(sizes)]
        over = {i for i in range(len(sizes)) if i not in capped and t[i] > epochs * sizes[i]}
        if not over:
            return t
        capped |= over


@pytest.mark.parametrize("sizes", [[100, 100, 100], [10, 500, 90, 7], [1000, 1, 1, 1, 1], [0, 50, 50]])
def test_targets_by_repeated_sharing(spark, sizes):
    frame = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(frame).collect()}
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    for i, want in enumerate(_water(sizes, weights, 1.5, 2)):
        assert got[f"s{i}"] == pytest.approx(want)


def test_taken_words_come_near_their_targets(spark):
    rows = [(i, ("a", "b", "c", None)[min(i % 7, 3)], 5 + i % 11) for i in range(4000)]
    out = _mix(spark, rows)
    assert sorted(r.doc_id for r in out) == list(range(4000))
    for source in ("a", "b", "c", None):
        of = [r for r in out if r.source == source]
        assert abs(sum(r.taken for r in of) - of[0].target) <= 40
        assert all(r.taken in (0, r.size, 2 * r.size) for r in of)
    assert sum(r.taken for r in out) <= 1.5 * sum(r.size for r in out) + 1
    assert {(r.doc_id, r.taken) for r in _mix(spark, rows[::-1])} == {(r.doc_id, r.taken) for r in out}


def test_odd_rows(spark):
    out = _mix(spark, [(1, "a", 10), (1, "a", 10), (None, None, 4), (2, "a", None), (3, "z", 0)])
    assert len(out) == 5
    assert [r.taken for r in out if r.doc_id in (2, 3)] == [0, 0]
    assert _mix(spark, []) == []
    assert [r.times for r in _mix(spark, [(1, "a", 0)])] == [0]


def test_clashing_columns_play_no_part(spark):
    frame = spark.createDataFrame([(1, "a", 3, "x", 0)], SCHEMA + ", key string, target long")
    assert [(r.size, r.source_size) for r in mixing.mix(frame).collect()] == [(3, 3)]
