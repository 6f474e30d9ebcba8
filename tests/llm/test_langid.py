"""Language identification: evidence by evidence, odd rows."""

from cohortlens.llm import langid

DOCS = [(i, t, lang) for i, (t, lang) in enumerate([
    ("the cat sat on the mat and the dog with the ball was there " * 3, "en"),
    ("der hund und die katze mit dem ball auf der matte waren nicht da " * 3, "de"),
    (None, "de"), ("text without a language", None)])]


def _pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, lang string")


def _run(spark, rows):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, lang string")
    return langid.identify(_pages(spark, rows), docs).collect()


def test_parts_of_a_page():
    page = "<html lang=\"DE-at\"><!-- the --><script>var a='<p>the</p>'</script><p>Katze&amp;Hund</p><style>x"
    assert langid.declared(page) == "de" and langid.visible(page).split() == ["Katze&Hund"]
    assert langid.host("https://u:p@Www.Example.ORG.:80/x") == "www.example.org"
    assert langid.host("no address") is None and langid.host(None) is None and langid.declared(None) is None
    assert langid.visible("<script>" * 50_000) == " "


def test_text_decides(spark):
    out = {r.page_id: r for r in _run(spark, [
        (1, "http://a.example.de/x", "<html><p>die katze und der hund waren auf der matte</p>"),
        (2, "http://b.example.com/x", "<html><p>the dog and the cat on the mat with the ball</p>")])}
    assert (out[1].lang, out[2].lang) == ("de", "en") and out[1].suffix == "de"


def test_declaration_and_host_settle_pages_without_text(spark):
    rows = [(i, f"http://www.kat.org/{i}", "<html lang=de><p>die katze und der hund mit dem ball</p>") for i in range(30)]
    rows += [(100 + i, f"http://www.dog.org/{i}", "<html lang=en><p>the dog and the cat with the ball</p>") for i in range(30)]
    rows += [(200, "http://www.kat.org/empty", None), (201, "http://www.dog.org/empty", ""), (202, None, "<html lang=de>")]
    out = {r.page_id: r for r in _run(spark, rows)}
    assert (out[200].lang, out[201].lang, out[202].lang) == ("de", "en", "de")
    assert 0.5 < out[200].probability <= 1


def test_odd_rows(spark):
    out = _run(spark, [(None, None, None), (1, "u", "x"), (1, "u", "x")])
    assert len(out) == 3 and all(r.lang in ("de", "en") for r in out)
    assert _run(spark, []) == []
    none = langid.identify(_pages(spark, [(1, "http://a.b/", "x")]), spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert [(r.page_id, r.lang) for r in none.collect()] == [(1, None)]


def _posterior(docs, pages, temper=0.3, said_smooth=1.0, host_smooth=5.0):
    """(language, probability, text language) of each page by plain loops over the definition."""
    import math
    from collections import Counter

    def grams(text):
        words = text.encode().lower().split()
        line = b" " + b" ".join(words) + b" " if words else b""
        return [((int.from_bytes(line[i:i + 3], "big") * 0x9E3779B1) >> 7) % (1 << 15) for i in range(len(line) - 2)]

    seen = {}
    for _, text, lang in docs:
        if lang is not None:
            seen.setdefault(lang.lower(), Counter()).update(grams(text or ""))
    langs = sorted(x for x in seen if seen[x])
    logs = {x: (lambda c, size: lambda g: math.log((c[g] + 0.5) / size))(seen[x], sum(seen[x].values()) + 0.5 * (1 << 15)) for x in langs}
    facts = []
    for _, url, page, *_ in pages:
        like = [temper * sum(logs[x](g) for g in grams(langid.visible(page))) for x in langs]
        odds = [math.exp(v - max(like)) for v in like]
        host = langid.host(url)
        labels = host.split(".") if host else None
        facts.append((like, [o / sum(odds) for o in odds], langid.declared(page), host,
                      ".".join(labels[-2:]) if labels else None, labels[-1] if labels else None))
    whole = [sum(f[1][k] for f in facts) + 1 for k in range(len(langs))]
    kinds = len({f[2] for f in facts})
    out = []
    for i, (like, share, said, *place) in enumerate(facts):
        def others(column, value):
            return [sum(f[1][k] for j, f in enumerate(facts) if j != i and value is not None and f[column] == value) for k in range(len(langs))]

        prior = [w / sum(whole) for w in whole]
        for column, value in ((5, place[2]), (4, place[1]), (3, place[0])):
            rest = others(column, value)
            prior = [(c + host_smooth * p) / (sum(rest) + host_smooth) for c, p in zip(rest, prior)]
        total = [a + math.log(p) for a, p in zip(like, prior)]
        if said is not None:
            total = [t + math.log((c + said_smooth) / (w + said_smooth * kinds)) for t, c, w in zip(total, others(2, said), whole)]
        odds = [math.exp(t - max(total)) for t in total]
        out.append((langs[odds.index(max(odds))], max(odds) / sum(odds), langs[share.index(max(share))]))
    return out


def test_posterior_by_hand(spark):
    """Every evidence at once, on pages that disagree, against loops over the definition."""
    import random

    rng = random.Random(6)
    words = {"en": "the and was there with dog cat on".split(), "de": "der und die nicht auf hund mit dem".split(), "fr": "le et les pas sur chien avec dans".split()}
    docs = [(i, " ".join(rng.choice(words[x]) for _ in range(60)), x.upper() if i % 5 == 0 else x) for i, x in enumerate(["en", "de", "fr"] * 8)]
    pages = []
    for i in range(60):
        lang, other = rng.choice(list(words)), rng.choice(list(words))
        text = " ".join(rng.choice(words[lang if rng.random() < 0.8 else other]) for _ in range(rng.choice([0, 1, 3, 30])))
        head = rng.choice(["<html>", f"<html lang='{lang}'>", f"<html lang={other}-x>", ""])
        url = rng.choice([None, "no address", f"http://{rng.choice('ab')}.{lang}.example.{rng.choice(['org', lang])}/p", "https://one.example.org/", "http://localhost/"])
        pages.append((i if i % 9 else None, url, rng.choice([None, f"{head}<p>{text}</p>"]) if i % 11 == 0 else f"{head}<p>{text}</p>"))
    frame = spark.createDataFrame([(i, t, x) for i, t, x in docs], "doc_id long, text string, lang string")
    got = langid.identify(_pages(spark, [(k, u, h) for k, u, h in pages]), frame).collect()
    want = _posterior(docs, pages)
    rounded = sorted((str(p[0]), w[0], round(w[1], 9), w[2]) for p, w in zip(pages, want))
    assert sorted((str(r.page_id), r.lang, round(r.probability, 9), r.text_lang) for r in got) == rounded


def test_ties_go_to_the_first_language(spark):
    docs = spark.createDataFrame([(1, "same words here", "zz"), (2, "same words here", "aa")], "doc_id long, text string, lang string")
    out = langid.identify(_pages(spark, [(1, None, "<p>same words</p>"), (2, None, None)]), docs).collect()
    assert {(r.lang, r.text_lang, round(r.probability, 9)) for r in out} == {("aa", "aa", 0.5)}
