"""Quality: the ranking separates, thresholds, odd rows."""

import random

import numpy as np

from cohortlens.llm import quality


def _texts(n, seed=2):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 9)))
    good = [" ".join(word() for _ in range(rng.randint(20, 200))) + "." for _ in range(n)]
    bad = [" ".join([word() + rng.choice(["***", "%%%"]) for _ in range(rng.randint(20, 200))]) for _ in range(n // 4)]
    bad += [" ".join([word()] * rng.randint(20, 200)) for _ in range(n // 4)]
    return good, bad


def test_ranking_orders_pairs():
    good, bad = _texts(200)
    x = np.array([quality.features(t) for t in good + bad])
    y = np.array([1] * len(good) + [0] * len(bad))
    model = quality.fit(x[::2], y[::2])
    s = model.scores(x[1::2])
    assert ((s >= 0.5) == (y[1::2] == 1)).mean() > 0.97
    assert ((0 <= s) & (s <= 1)).all()


def test_one_label_or_none():
    x = np.array([quality.features("some words here"), quality.features("others")])
    assert (quality.fit(x, np.array([1, 1])).scores(x) >= 0.5).all()
    assert (quality.fit(x, np.array([0, 0])).scores(x) < 0.5).all()
    assert (quality.fit(np.zeros((0, quality.SIZE)), np.zeros(0)).scores(x) == 0.5).all()


def test_whole_texts_are_read():
    assert not np.allclose(quality.features("word " * 100_000), quality.features("word " * 100_000 + "*** " * 5000))


def test_held_out_labels_teach_nothing(spark):
    good, bad = _texts(120)
    docs = spark.createDataFrame(list(enumerate([*good, *bad, None, ""])), "doc_id long, text string").union(
        spark.createDataFrame([(None, "no id")], "doc_id long, text string"))
    labels = spark.createDataFrame([(i, int(i < len(good))) for i in range(len(good) + len(bad))] + [(None, 1), (3, None)],
                                   "doc_id long, quality int")
    first = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    assert len(first) == len(good) + len(bad) + 3
    held = [i for i, r in first.items() if r.held_out]
    assert sum(first[i].predicted == int(i < len(good)) for i in held if i < len(good) + len(bad)) >= 0.95 * len(held) - 2
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality")
    again = {r.doc_id: r.score for r in quality.quality_scores(docs, turned).collect()}
    assert all(abs(again[i] - r.score) < 1e-9 for i, r in first.items())
    assert quality.quality_scores(docs.limit(0), labels).count() == 0


def test_extra_columns_pass_through(spark):
    docs = spark.createDataFrame([("t", 1, "s")], "text string, c0 int, score string")
    model = quality.fit(np.zeros((0, quality.SIZE)), np.zeros(0))
    out = quality.scored(docs, model, score_column="_score")
    assert out.columns == ["text", "c0", "score", "_score"] and tuple(out.first()) == ("t", 1, "s", 0.5)


def test_weights_maximise_the_pair_likelihood():
    """The Newton fit against plain gradient ascent over all pairs, and its threshold against a sorted list."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, quality.SIZE))
    y = (x[:, 0] + 0.5 * x[:, 3] + 0.5 * rng.normal(size=40) > 0.3).astype(int)
    model = quality.fit(x, y, pairs=4, penalty=0.05)
    z = np.clip((x - x.mean(0)) / (x.std(0) + 1e-9), -8, 8)
    good, bad = z[y == 1], z[y == 0]
    n, draw = max(len(good), len(bad)) * 4, np.random.default_rng(5)
    pairs = list(zip(draw.permutation(np.arange(n) % len(good)), draw.permutation(np.arange(n) % len(bad))))
    d, w = np.array([good[a] - bad[b] for a, b in pairs]), np.zeros(quality.SIZE)
    for _ in range(6000):
        w = w + 0.2 * (d.T @ (1 / (1 + np.exp(d @ w))) / n - 0.05 * w)
    assert np.allclose(model.weights, w, atol=1e-6)
    scores, k = sorted((z @ w).tolist()), round((y == 0).mean() * 40)
    assert abs(model.threshold - (scores[k - 1] + scores[k]) / 2) < 1e-5
    assert np.allclose(model.scores(x), 1 / (1 + np.exp(model.threshold - z @ model.weights)))


def test_features_by_plain_loops():
    text = "Ab ab ab, 12!\nÜx  ab\n\nAb ab ab, 12!\n"
    data, words = text.encode(), text.split()
    f = quality.features(text)
    share = lambda test: sum(map(test, data)) / len(data)
    assert np.allclose(f[:6], [share(lambda b: 65 <= b < 91), share(lambda b: 97 <= b < 123), share(lambda b: 48 <= b < 58), share(lambda b: b >= 128),
                               share(lambda b: b in (10, 13)), share(lambda b: b in (32, 9))])
    comma = 7 + quality.SYMBOLS.index(b",")
    assert np.isclose(f[comma], (2 / len(words)) ** 0.5)
    n, lines = len(words), [x for x in text.split("\n") if x.strip()]
    again = sum(a == b for a, b in zip(words, words[1:]))
    assert np.allclose(f[-8:-4], [len(set(words)) / n, np.log(len(set(words))) / np.log(n + 1), again / n, len(set(lines)) / len(lines)])
    assert np.allclose(f[-4:], [np.log1p(n), np.log1p(len(data) / n), np.log1p(n / len(lines)), 1 / n])
    assert not quality.features("  \n").any() and not quality.features(None).any()


def test_repeated_ids_do_not_follow_the_layout(spark):
    """More rows than labels: which of them teach depends on their content alone."""
    rows = [(i % 20, f"{'good plain words of text ' if i % 20 % 2 else 'x!! @@ ## '}{i} " * 5) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    first, second = (quality.learned(d, labels, labelled_rows=10) for d in (docs.coalesce(1), docs.repartition(7)))
    assert np.allclose(first.weights, second.weights) and first.threshold == second.threshold
