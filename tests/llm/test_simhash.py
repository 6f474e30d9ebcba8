"""SimHash: fingerprints by their definition, links and components by brute force."""

import random

from xxhash import xxh64_intdigest

from cohortlens.llm import simhash
from cohortlens.llm.components import components


def _plain(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    bits = [sum(xxh64_intdigest(g, 42) >> b & 1 for g in grams) * 2 > len(grams) for b in range(64)]
    return sum(1 << b for b, on in enumerate(bits) if on)


def _component(ids, linked):
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if root[b] < root[a] and linked(a, b):
                    root[a], changed = root[b], True
    return root


def test_fingerprint_by_definition():
    rng = random.Random(3)
    for text in (None, "", " \t\n", "One", "one Two", "a b c", "É é x", "a " * 50,
                 *(" ".join(rng.choice("abcdefgh") for _ in range(n)) for n in (4, 30, 300))):
        assert simhash.fingerprint(text) % (1 << 64) == _plain(text)


def test_linked_finds_every_pair_within_three_bits(spark):
    rng = random.Random(1)
    fps = set()
    while len(fps) < 400:
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 8)):
            fps.add(base)
            for bit in rng.sample(range(64), rng.randint(1, 4)):
                base ^= 1 << bit
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    links = simhash.linked(spark.createDataFrame([(f,) for f in fps], "fp long"))
    got = {r.id: r.root for r in components(links).collect()}
    want = _component(fps, lambda a, b: bin((a ^ b) % (1 << 64)).count("1") <= 3)
    assert {f: got.get(f, f) for f in fps} == want


def test_groups_and_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(400))
    rows = [(5, text), (3, text), (3, text), (None, text), (8, None), (7, ""), (9, "Solo words here"), (4, text + " end")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string")
    out = simhash.near_duplicates(frame).collect()
    assert len(out) == len(rows)
    root = {r.doc_id: r.component_id for r in out}
    assert (root[5], root[3], root[None], root[8], root[7], root[9]) == (3, 3, 3, 7, 7, 9)
    linked = bin((simhash.fingerprint(text) ^ simhash.fingerprint(text + " end")) % (1 << 64)).count("1") <= 3
    assert root[4] == (3 if linked else 4)
    assert simhash.near_duplicates(frame.limit(0)).count() == 0


def test_components_of_chains_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7), (5, None)]
    got = {r.id: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}
