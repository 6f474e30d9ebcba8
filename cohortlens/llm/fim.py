"""Fill-in-the-middle rearrangement: one repeated-capture match finds every line and both cuts."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import arrow

LINE = r"[^\n]*\n|[^\n]+"
STEP_ROWS = 256


@dataclass(frozen=True)
class Plan:
    """How texts are cut and written.

    ``rate`` and ``spm`` are percentages: of texts that are rearranged at all, and of these the
    ones written suffix first. ``unit`` must match every text piece by piece, without a choice
    that depends on what follows the piece.
    """

    seed: int = 7
    rate: int = 100
    spm: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    unit: str = LINE

    def __post_init__(self):
        marks = (self.prefix, self.suffix, self.middle)
        for i, a in enumerate(marks):
            for j, b in enumerate(marks):
                meets = any(a[-n:] == b[:n] for n in range(1, min(len(a), len(b)) + (i != j)))
                if not a or meets or (i != j and a in b):
                    raise ValueError(f"sentinels {a!r} and {b!r} are empty or can overlap, so texts could not be restored")

    def pattern(self):
        # Possessive, so that a text of many lines keeps captures only and no way back.
        return regex.compile(f"({self.unit})*+")

    def draws(self, doc_id) -> tuple[int, int, int, int]:
        """Four 32-bit numbers that the seed and the id fix."""
        digest = hashlib.sha256(f"{self.seed}:{'' if doc_id is None else doc_id}".encode()).digest()
        return tuple(int.from_bytes(digest[i:i + 4], "big") for i in (0, 4, 8, 12))

    def rearranged(self, doc_id, text: str, pattern) -> tuple[int, str, int | None, int | None, str]:
        """Number of units, form, length of prefix and of middle, and the text as written."""
        found = pattern.fullmatch(text)
        if found is None:
            raise ValueError(f"the unit {self.unit!r} does not cover the text of document {doc_id}")
        ends = found.ends(1)
        n = len(ends)
        h1, h2, h3, h4 = self.draws(doc_id)
        if not text or any(mark in text for mark in (self.prefix, self.suffix, self.middle)) or h3 % 100 >= self.rate:
            return n, "plain", None, None, text
        first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
        p, m = (ends[first - 1] if first else 0), (ends[second - 1] if second else 0)
        prefix, middle, suffix = text[:p], text[p:m], text[m:]
        if h4 % 100 < self.spm:
            return n, "spm", p, m - p, f"{self.suffix}{suffix}{self.prefix}{prefix}{self.middle}{middle}"
        return n, "psm", p, m - p, f"{self.prefix}{prefix}{self.suffix}{suffix}{self.middle}{middle}"

    def restored(self, output: str, form: str) -> str:
        """The text that a rearranged one was made from. No sentinel can start in one part and end in the next."""
        if form == "plain":
            return output
        lead, between = (self.prefix, self.suffix) if form == "psm" else (self.suffix, self.prefix)
        first, rest = output[len(lead):].split(between, 1)
        second, middle = rest.split(self.middle, 1)
        prefix, suffix = (first, second) if form == "psm" else (second, first)
        return prefix + middle + suffix


def fill_in_middle(docs: DataFrame, plan: Plan = Plan(), text_column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output``: every text cut at two unit ends and rearranged.

    One match of ``(unit)*`` over the whole text keeps the end of every repetition: their number is n
    and the cuts are two of them. A null text is empty; an empty text, one that holds a sentinel, or one
    beyond the rate stays plain with null lengths. Cuts depend on seed and id alone, so equal rows give
    equal results; a null id counts as an empty one. Lengths are in code points. A text is held in memory
    once with the ends of its units, so very long texts need a small multiple of their size. Other columns
    are not read. Empty table: no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                        ("middle_chars", pa.int64()), ("output", pa.string())])

    def run(batches):
        pattern = plan.pattern()
        for b in batches:
            for at in range(0, b.num_rows, STEP_ROWS):
                part = b.slice(at, STEP_ROWS)
                rows = [(doc, *plan.rearranged(doc, text or "", pattern))
                        for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
                yield arrow(schema, **dict(zip(schema.names, zip(*rows))))

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(rows: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """The rows of ``fill_in_middle`` with ``restored``, the text rebuilt from output and form alone."""
    @F.pandas_udf("string")
    def rebuild(output, form):
        import pandas as pd

        return pd.Series([None if o is None else plan.restored(o, f) for o, f in zip(output, form)])

    return rows.withColumn("restored", rebuild("output", "form"))
