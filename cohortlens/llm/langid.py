"""Language of web pages: text likelihood, declared language, address suffix and smoothed host priors, fused by Bayes."""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import LOWER, raw, stored

BUCKETS = 1 << 15  # cells that byte trigrams fall into
TEMPER = 0.3  # weight of one trigram: neighbouring trigrams overlap, so they are not independent evidence
DECLARED_SMOOTHING, HOST_SMOOTHING = 1.0, 5.0

_HIDDEN = re.compile(r"(?is)<(script|style)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)")
_TAG = re.compile(r"<[^<>]*>")
_LANG = re.compile(r"(?i)<html\b[^<>]*?\blang\s*=\s*[\"']?([A-Za-z]+)")
_HOST = re.compile(r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")


def visible(page: str | None) -> str:
    """Text of a page without scripts, styles, comments and tags."""
    return html.unescape(_TAG.sub(" ", _HIDDEN.sub(" ", page or "")))


def declared(page: str | None) -> str | None:
    m = _LANG.search(page or "")
    return m[1].lower() if m else None


def host(url: str | None) -> str | None:
    m = _HOST.match(url or "")
    return m[1].lower().strip(".") or None if m else None


def trigrams(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """Cells of the byte trigrams of the lower-cased words, one space around each."""
    words = raw(text).translate(LOWER).split()
    if not words:
        return np.zeros(0, np.int64)
    b = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.int64)
    code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    return ((code * 0x9E3779B1) >> 7) % buckets


def learn_text(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", buckets: int = BUCKETS) -> tuple[list, np.ndarray]:
    """Languages, sorted, and log P(trigram cell | language), from all rows that name one.

    Tasks count cells per language with numpy; one grouped sum adds them. What
    reaches the driver is at most ``buckets`` numbers per language.
    """
    schema = pa.schema([("lang", pa.string()), ("cell", pa.int64()), ("n", pa.int64())])

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                here = sums.setdefault(lang, np.zeros(buckets, np.int64))
                here += np.bincount(trigrams(text.as_py(), buckets), minlength=buckets)
        for lang, n in sums.items():
            cell = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cell)), pa.array(cell), pa.array(n[cell])], schema=schema)

    rows = docs.where(F.col(lang_column).isNotNull()).select(
        F.lower(F.col(lang_column).cast("string")).alias("lang"), F.col(text_column).cast("string").alias("text"))
    counts = rows.mapInArrow(run, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique().tolist())
    table = np.full((buckets, len(langs)), 0.5)
    np.add.at(table, (counts["cell"].to_numpy(int), np.searchsorted(langs, counts["lang"].to_numpy()) if langs else []),
              counts["n"].to_numpy(float))
    return langs, np.log(table / table.sum(axis=0))


def identify(pages: DataFrame, docs: DataFrame, html_column: str = "html", url_column: str = "url", id_column: str = "page_id",
             text_column: str = "text", lang_column: str = "lang", buckets: int = BUCKETS, temper: float = TEMPER,
             declared_smoothing: float = DECLARED_SMOOTHING, host_smoothing: float = HOST_SMOOTHING) -> DataFrame:
    """``page_id, lang, probability, text_lang, declared, host, suffix`` per row of ``pages``.

    1. Text alone: trigram likelihoods learned from ``docs`` and its languages give each
       page a share per language.
    2. Grouped sums of these shares over declared languages, hosts, domains (last two
       labels), suffixes (last label) and all pages. A declaration counts by P(declared |
       language); the prior of a host is its own sum, without the page itself, smoothed by its
       domain's, that by its suffix's, that by the overall one.
    3. The posterior is text times declaration times prior; ties go to the first language.

    A page without text, declaration or address has only the other evidence; a null
    id is kept; repeated rows are rows of their own. Without any learned language all
    results are null. Sums go through partial aggregation, so a hot host costs one row a task;
    its pages meet the sum in a join that adaptive execution splits.
    """
    langs, table = learn_text(docs, text_column, lang_column, buckets)
    n = len(langs)
    schema = pa.schema([("page_id", pa.int64()), ("declared", pa.string()), ("host", pa.string()),
                        ("like", pa.list_(pa.float64()))])

    def run(batches):
        for b in batches:
            like = []
            for page in b.column(2):
                cells = trigrams(visible(page.as_py()), buckets)
                like.append((table[cells].sum(axis=0) * temper).tolist() if n else [])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([declared(p.as_py()) for p in b.column(2)], pa.string()),
                 pa.array([host(u.as_py()) for u in b.column(1)], pa.string()), pa.array(like, pa.list_(pa.float64()))], schema=schema)

    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"),
                        F.col(html_column).cast("string").alias("html"))
    rows = rows.mapInArrow(run, "page_id long, declared string, host string, like array<double>")
    if not n:
        none = F.lit(None).cast("string")
        return rows.select("page_id", none.alias("lang"), none.cast("double").alias("probability"), none.alias("text_lang"),
                           "declared", "host", F.element_at(F.split("host", "\\."), -1).alias("suffix"))

    def shares(logs):
        odds = F.transform(logs, lambda v: F.exp(v - F.array_max(logs)))
        return F.transform(odds, lambda v: v / F.aggregate(odds, F.lit(0.0), lambda a, x: a + x))

    labels = F.split("host", "\\.")
    rows = rows.withColumn("share", shares(F.col("like")))
    rows = rows.withColumn("domain", F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."))
    rows = stored(rows.withColumn("suffix", F.element_at(labels, -1)), "pages")

    def sums(key):
        return rows.groupBy(key).agg(F.array(*[F.sum(F.col("share")[i]) for i in range(n)]).alias(f"in_{key}"))

    total = rows.agg(*[F.sum(F.col("share")[i]) for i in range(n)]).first()
    whole = np.array([v or 0.0 for v in total]) + 1.0
    prior = F.array(*[F.lit(float(v)) for v in whole / whole.sum()])
    zero = F.array(*[F.lit(0.0)] * n)

    def smoothed(counts, own, upper):
        """(counts - own + m * upper) / (their sum + m), elementwise; a missing group leaves the upper level."""
        rest = F.zip_with(F.coalesce(counts, own), own, lambda c, o: F.greatest(c - o, F.lit(0.0)))
        size = F.aggregate(rest, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(rest, upper, lambda c, u: (c + u * host_smoothing) / (size + host_smoothing))

    out = rows
    for key in ("declared", "suffix", "domain", "host"):
        other = sums(key).where(F.col(key).isNotNull()).withColumnRenamed(key, f"_{key}")
        out = out.join(other, F.col(key) == F.col(f"_{key}"), "left").drop(f"_{key}")
    for key, upper in (("suffix", prior), ("domain", F.col("by_suffix")), ("host", F.col("by_domain"))):
        out = out.withColumn(f"by_{key}", smoothed(F.col(f"in_{key}"), F.col("share"), upper))
    kinds = float(max(rows.select("declared").distinct().count(), 1))
    own = F.col("share")
    said = F.zip_with(F.zip_with(F.coalesce("in_declared", own), own, lambda c, o: F.greatest(c - o, F.lit(0.0))),
                      F.array(*[F.lit(float(v)) for v in whole]),
                      lambda c, w: F.log((c + declared_smoothing) / (w + declared_smoothing * kinds)))
    said = F.when(F.col("declared").isNotNull(), said).otherwise(zero)
    logs = F.zip_with(F.zip_with("like", said, lambda a, b: a + b), "by_host", lambda a, p: a + F.log(p))
    names = F.array(*[F.lit(v) for v in langs])
    out = out.withColumn("logs", logs).withColumn("posterior", shares(F.col("logs")))

    def best(column):
        return F.element_at(names, F.array_position(column, F.array_max(column)).cast("int"))

    return out.select("page_id", best(F.col("posterior")).alias("lang"), F.array_max("posterior").alias("probability"),
                      best(F.col("share")).alias("text_lang"), "declared", "host", "suffix")
