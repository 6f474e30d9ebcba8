"""The pipeline's stages on a small corpus, and the registered queries."""

import __spark_entry__ as entry
import corpus_pipeline
from cohortlens.llm import simhash
from cohortlens.llm.queries import ORACLES, QUERIES
from tests.oracle import compare, connect


def test_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_queries_run(spark, sf_dir):
    for name, fn in QUERIES.items():
        assert fn(spark, sf_dir).count() > 0, name


def test_oracles(spark, sf_dir):
    con = connect(sf_dir)
    for name, sql in ORACLES.items():
        assert compare(spark, con, name, QUERIES[name], sql, sf_dir) is None


def test_stages_one_by_one(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    steps = dict(corpus_pipeline.STAGES)
    good = steps["quality"](spark, docs, sf_dir)
    assert good.columns == docs.columns and 0 < good.count() < docs.count() and good.subtract(docs).count() == 0
    one = steps["simhash"](spark, docs, sf_dir)
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect()) == sorted(set(groups.values()))
    hidden = {r.doc_id: r for r in steps["pii"](spark, docs, sf_dir).collect()}
    assert len(hidden) == docs.count() and any("[EMAIL]" in (r.text or "") for r in hidden.values())
    mixed = steps["mixing"](spark, docs, sf_dir)
    assert mixed.columns == docs.columns and mixed.subtract(docs).count() == 0
    words = lambda df: sum(len((r.text or "").encode().split()) for r in df.collect())
    assert abs(words(mixed) - 1.5 * words(docs)) < 0.05 * words(docs)
    packed = steps["packing"](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_odd_rows_go_through(spark, sf_dir):
    rows = [(1, None, None, None, None), (None, "some words here " * 20, "en", "s", 3), (None, "other words " * 30, "en", None, 3),
            (2, "", "en", "s", 0), (2, "", "en", "s", 0), (900_001, "mail ann@x.org " + "plain words follow here " * 10, "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
        stage(spark, docs, sf_dir).collect()
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() >= len(rows)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _text(seed):
    return " ".join(f"{seed}{i}" for i in range(60))


def test_one_copy_is_chosen_by_row(spark, sf_dir):
    rows = [(None, _text("n")), (None, _text("n")), (3, _text("m")), (None, _text("m")), (None, _text("solo")),
            (5, _text("a")), (5, _text("b")), (7, _text("b")), (8, _text("c")), (8, _text("c"))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    out = dict(corpus_pipeline.STAGES)["simhash"](spark, docs, sf_dir)
    got = sorted(((r.doc_id or 0, r.text) for r in out.collect()))
    assert out.columns == docs.columns
    assert got == sorted([(0, _text("n")), (3, _text("m")), (0, _text("solo")), (5, _text("a")), (5, _text("b")), (8, _text("c"))])


def test_rows_without_an_id_stay_within_the_budget(spark, sf_dir):
    rows = [(None if i % 3 else i % 40, "word " * 8, "en", "abc"[i % 3], i) for i in range(600)]
    docs = spark.createDataFrame(rows, DOCS)
    out = dict(corpus_pipeline.STAGES)["mixing"](spark, docs, sf_dir).collect()
    assert 1.5 * 600 - 4 <= len(out) <= 1.5 * 600
    times = [sum(r.n_chars == i for r in out) for i in range(600)]
    assert set(times) <= {0, 1, 2}


def test_clashing_columns_come_back(spark, sf_dir):
    """Columns named like the stages' own ones keep their values, and a stage decides as it does without them."""
    names = ["_row", "_SCORE", "_times", "_copy", "score", "component_id", "times", "size", "key"]
    rows = [(i, _text("abc"[i % 3]) if i % 2 else "plain words of a text " * (5 + i), "en", "st"[i % 2], 9) for i in range(30)]
    plain = spark.createDataFrame(rows, DOCS)
    clash = spark.createDataFrame([(*r, *[777] * len(names)) for r in rows], DOCS + "".join(f", `{n}` int" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        want = sorted(map(tuple, stage(spark, plain, sf_dir).collect()))
        out = stage(spark, clash, sf_dir)
        assert out.columns == clash.columns, name
        got = sorted(map(tuple, out.collect()))
        assert [r[:5] for r in got] == want and all(set(r[5:]) == {777} for r in got), name
    packed = corpus_pipeline.STAGES[-1][1]
    assert packed(spark, clash, sf_dir).count() == packed(spark, plain, sf_dir).count()


def test_whole_pipeline(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and "sequence_id" in out.columns
