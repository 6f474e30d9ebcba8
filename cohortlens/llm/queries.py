"""One query per operator, over the whole table it is meant for, and the SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import bestfit, crosstok, ctw, fim, hilbert, langid, lattice, mixing, packing, pii, quality, rlz, simhash


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context-tree weighting scores of all documents, learned from four fifths of them."""
    return ctw.scores(_table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = pii.personal_data(_table(spark, sf_dir, "documents"))

    def written(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in pii.BASE],
                        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def op3_rlz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that stand in a window of 35 words found elsewhere too."""
    found = rlz.duplicate_spans(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate embeddings by E8 lattice hashing, cosine 0.95."""
    return lattice.near_duplicates(_table(spark, sf_dir, "embeddings"), 0.95)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from preference pairs of the labelled ones."""
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 2048 tokens."""
    return packing.packed(_table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash near-duplicates of all documents, 3-word shingles, 3 bits."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest embeddings found for every hundredth id."""
    return hilbert.neighbours(_table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0", 10)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents to weights 5, 2, 1 and 150 % of all words."""
    docs = _table(spark, sf_dir, "documents").withColumn("_words", mixing.word_count("text"))
    return mixing.mix(docs, "_words").select("doc_id", "size", "source_size", "target", "taken")


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page; text likelihoods come from all documents."""
    return langid.identify(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut at two line ends and rearranged, and the text rebuilt from that."""
    rows = fim.restored(fim.fill_in_middle(_table(spark, sf_dir, "documents")))

    def digest(column):
        return F.sha2(F.col(column).cast("binary"), 256).alias(f"{column}_sha256")

    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


def op12_crosstok(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of two tokenizers over all documents."""
    found = crosstok.align(_table(spark, sf_dir, "documents"), digest=True).documents
    return found.withColumnRenamed("groups", "groups_sha256")


def op13_bestfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in as few sequences of 2048 tokens as found, cut only where longer."""
    return bestfit.packed(_table(spark, sf_dir, "documents"))


_SIZED = "SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size, md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents"

OP9_SQL = f"""
WITH d AS ({_SIZED}),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS DOUBLE) AS w FROM s),
l AS (SELECT *, CAST(2 * source_size AS DOUBLE) AS top,
  sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(2 * source_size) OVER o, 0) AS rest,
  sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS wrest
  FROM w WINDOW o AS (ORDER BY 2 * source_size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(top, w * max(rest / wrest) OVER ()) AS target FROM l),
u AS (SELECT d.*, t.source_size, t.target, CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY key, doc_id, d.size
   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, x.e AS epoch, (upto + x.e * source_size) / target AS finish FROM u, (VALUES (0), (1)) x(e) WHERE target > 0),
c AS (SELECT doc_id, size, sum(size) OVER (ORDER BY finish, key, coalesce(CAST(doc_id AS VARCHAR), ''), epoch
   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= (SELECT sum(target) FROM t) AS inside FROM e)
SELECT doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target,
 CAST(coalesce(any_value(taken), 0) AS BIGINT) AS taken
FROM (SELECT u.doc_id, u.size, u.source_size, u.target, k.taken FROM u
 LEFT JOIN (SELECT doc_id, sum(size) FILTER (inside) AS taken FROM c GROUP BY doc_id) k USING (doc_id)) GROUP BY doc_id"""

OP3_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
i AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d),
w AS (SELECT doc_id, i, ws[i] AS word, CASE WHEN i + 34 <= len(ws) THEN array_to_string(ws[i:i + 34], ' ') END AS win FROM i),
c AS (SELECT *, win IS NOT NULL AND count(*) OVER (PARTITION BY win) > 1 AS again FROM w),
r AS (SELECT *, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM c)
SELECT d.doc_id, CAST(len(any_value(ws)) AS BIGINT) AS n_words, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed,
 sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM d LEFT JOIN r ON d.doc_id = r.doc_id GROUP BY d.doc_id"""

OP4_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r(id, other) AS (SELECT a, b FROM l UNION SELECT r.id, l.b FROM r JOIN l ON r.other = l.a)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, least(v.vec_id, min(r.other)) AS component_id,
 v.vec_id = least(v.vec_id, min(r.other)) AS kept
FROM v LEFT JOIN r ON r.id = v.vec_id GROUP BY v.vec_id"""

OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
  sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT *, CAST(len(u) AS BIGINT) AS n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(x, i, 8))::BIGINT) AS h FROM d),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS c1, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS c2,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 100 THEN 'plain'
   WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, coalesce(array_to_string(u[1:c1], ''), '') AS a, coalesce(array_to_string(u[c1 + 1:c2], ''), '') AS m,
  coalesce(array_to_string(u[c2 + 1:n], ''), '') AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(a) AS BIGINT) END AS prefix_chars,
 CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || m
  ELSE '<S>' || z || '<P>' || a || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""

QUERIES = {"op1_ctw": op1_ctw, "op2_pii": op2_pii, "op3_rlz": op3_rlz, "op4_lattice": op4_lattice, "op5_quality": op5_quality, "op6_packing": op6_packing, "op7_simhash": op7_simhash, "op8_hilbert": op8_hilbert, "op9_mixing": op9_mixing, "op10_langid": op10_langid, "op11_fim": op11_fim, "op12_crosstok": op12_crosstok, "op13_bestfit": op13_bestfit}
ORACLES = {"op3_rlz": OP3_SQL, "op4_lattice": OP4_SQL, "op9_mixing": OP9_SQL, "op11_fim": OP11_SQL}
