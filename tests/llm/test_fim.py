"""Fill in the middle: cuts by a plain loop, exact restoration, odd rows."""

import hashlib
import random
import re

import pytest

from cohortlens.llm import fim


def by_loop(doc_id, text, plan=fim.Plan()):
    """The definition, unit by unit."""
    units = re.findall(plan.unit, text)
    h = hashlib.sha256(f"{plan.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if text == "" or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= plan.rate:
        return n, "plain", None, None, text
    if h4 % 100 < plan.spm:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


TEXTS = ["", "\n", "\n\n", "a", "a\n", "a\nb", "a\r\nb\n", "<P>", "a<S>\nb", "<", "<P\n>", "a<\nP>\n<M", "\x85 \n", "é😀\n漢\n", "<<P\n<S\n<M\n"]


def rows():
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice(["\n", "a", "<", "P", ">", "é", "😀", " ", "<S", "M>"]) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    return [(i, t) for i, t in enumerate(texts)] + [(None, "x\ny\n"), (5, None), (-7, "a\nb\nc"), (5, "a\nb\nc")]


@pytest.mark.parametrize("plan", [fim.Plan(), fim.Plan(seed=1, rate=40, spm=90), fim.Plan(unit=r"[^ ]* |[^ ]+")])
def test_equals_the_definition_and_comes_back(plan):
    pattern = plan.pattern()
    for doc, text in rows():
        got = plan.rearranged(doc, text or "", pattern)
        assert got == by_loop(doc, text or "", plan)
        assert plan.restored(got[4], got[1]) == (text or "")


def test_forms_all_occur():
    pattern = fim.Plan().pattern()
    assert {fim.Plan().rearranged(d, t or "", pattern)[1] for d, t in rows()} == {"plain", "spm", "psm"}


def test_long_texts():
    pattern = fim.Plan().pattern()
    for text in ("x\n" * 500_000, "\n" * 1_000_000, "y" * 3_000_000):
        got = fim.Plan().rearranged(11, text, pattern)
        assert got == by_loop(11, text)


@pytest.mark.parametrize("marks", [("", "<S>", "<M>"), ("<P>", "<P>", "<M>"), ("aba", "<S>", "<M>"), ("<S", "S>", "<M>"), ("<S>", "x<S>y", "<M>")])
def test_sentinels_that_could_not_be_found_again(marks):
    with pytest.raises(ValueError):
        fim.Plan(prefix=marks[0], suffix=marks[1], middle=marks[2])


def test_unit_must_cover_the_text():
    plan = fim.Plan(unit="a")
    with pytest.raises(ValueError):
        plan.rearranged(1, "ab", plan.pattern())


def test_frame(spark):
    data = rows()
    frame = spark.createDataFrame([(d, t, "clash", 1) for d, t in data], "doc_id long, text string, output string, n int").repartition(5)
    got = fim.restored(fim.fill_in_middle(frame)).collect()
    want = sorted(((d, *by_loop(d, t or ""), t or "") for d, t in data), key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == want
    assert fim.fill_in_middle(frame.limit(0)).count() == 0
