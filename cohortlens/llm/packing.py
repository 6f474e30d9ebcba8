"""Packing token pieces into fixed windows: non-negative least squares over shallow length combinations."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.byte_bpe import byte_letters
from cohortlens.llm.common import arrow, stored, tokenizer_path
from cohortlens.llm.windows import Filling, Places, length_counts, with_rank

WINDOW = 2048
END = 1
STEP_BYTES = 1 << 20  # characters of text that a task turns into pieces at a time
SLACK = 32  # tokens that a sequence of whole pieces may leave before pieces are cut
ODD_WORDS = 250_000  # words outside the alphabet below whose ids a worker process remembers
# Characters of which it is plain how the tokenizer's pattern, lower-casing and composition treat them:
# ASCII, letters and signs of Latin-1, general punctuation, the euro and trademark signs.
_LETTERS = "a-zß-öø-ÿ"
_PLAIN = "!-~¡-©«¬®-±´¶-¸»¿À-ÿ‐-‧‰-⁞€™"
_SPACE = "\\t-\\r "
_ODD = re.compile(f"(?<![^{_SPACE}])[{_PLAIN}]*+[^{_SPACE}{_PLAIN}][^{_SPACE}]*")
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\\s{_LETTERS}0-9]+")
_LAST = "\x01"  # stands for the end of a part; texts never show it to the merges


class Ids:
    """Token ids of texts as little-endian 32-bit bytes.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its parts.
    The vocabulary marks the last byte of a part with a suffix; written as a byte of its own behind the
    part, it is merged first, and the rest by rank. Words with other characters than the alphabet
    above, and texts that hold the start of a special token, go to the tokenizer itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        letters, suffix, ranks = byte_letters(), self.tokenizer.model.end_of_word_suffix, {}
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        for token, i in self.tokenizer.get_vocab().items():
            if token not in special:
                ends = token.endswith(suffix)
                ranks[bytes(letters[c] for c in token.removesuffix(suffix)) + _LAST.encode() * ends] = i
        self.merges = tiktoken.Encoding("parts", pat_str=f"[^{_LAST}]+{_LAST}", mergeable_ranks=ranks, special_tokens={})
        self.odd: dict[str, list[int]] = {}

    def _plain(self, text: str) -> list[int]:
        parts = _PARTS.findall(text.lower())
        parts.append("")
        return self.merges.encode_ordinary(_LAST.join(parts))

    def _word(self, word: str) -> list[int]:
        if (ids := self.odd.get(word)) is None:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
            if len(self.odd) >= ODD_WORDS:
                self.odd.clear()
            self.odd[word] = ids
        return ids

    def _ids(self, text: str) -> list[int]:
        if "<|" in text:
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        out, at = [], 0
        for word in _ODD.finditer(text):
            out += self._plain(text[at:word.start()])
            out += self._word(word.group())
            at = word.end()
        return out + self._plain(text[at:])

    def of(self, texts: list[str | None]) -> list[bytes]:
        return [np.array(self._ids(t or ""), "<u4").tobytes() for t in texts]


@cache
def ids_of(path: str) -> Ids:
    """One for all tasks of a worker process."""
    return Ids(path)


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END, text_column: str = "text",
           id_column: str = "doc_id") -> DataFrame:
    """Each row's ids and the end id, cut every ``window`` ids.

    ``doc_id, start, length, ids_crc32, doc_tokens, ids`` (little-endian 32-bit) and, for ranks within a length
    without a sort, the task ``part`` and the piece's number ``nth`` of its length there.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                        ("doc_tokens", pa.int64()), ("ids", pa.binary()), ("part", pa.int64()), ("nth", pa.int64())])
    last = int(end).to_bytes(4, "little")

    def run(batches):
        ids, part, seen = ids_of(tokenizer), TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)

        def cut(doc_ids, texts):
            rows = []
            for doc, data in zip(doc_ids, ids.of(texts)):
                data += last
                n = len(data) // 4
                for s in range(0, n, window):
                    size = min(window, n - s)
                    own = data[s * 4:(s + size) * 4]
                    rows.append((doc, s, size, zlib.crc32(own), n, own, part, int(seen[size])))
                    seen[size] += 1
            return arrow(schema, **dict(zip(schema.names, zip(*rows))))

        for b in batches:
            hold_ids, hold, size = [], [], 0
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                hold_ids.append(doc)
                hold.append(text.as_py())
                size += len(hold[-1] or "")
                if size >= STEP_BYTES:
                    yield cut(hold_ids, hold)
                    hold_ids, hold, size = [], [], 0
            if hold:
                yield cut(hold_ids, hold)

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, part long, nth long")


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """All one-, two- and three-piece combinations of present lengths that fill the window, padded with 0."""
    present = np.zeros(window + 1, bool)
    present[lengths] = True
    out = []
    if present[window]:
        out.append(np.array([[window, 0, 0]]))
    a = lengths[lengths * 2 <= window]
    a = a[present[window - a]]
    out.append(np.stack([a, window - a, np.zeros_like(a)], axis=1))
    for x in lengths[lengths * 3 <= window]:
        y = lengths[(lengths >= x) & (lengths * 2 <= window - x)]
        y = y[present[window - x - y]]
        out.append(np.stack([np.full_like(y, x), y, window - x - y], axis=1))
    return np.concatenate(out)


def repeat_counts(combos: np.ndarray, histogram: np.ndarray, steps: int = 150) -> np.ndarray:
    """x >= 0 that minimises ||A x - histogram||, A the pieces of each length in each combination.

    Accelerated projected gradient; A is applied by gather and by weighted counting.
    """
    size = len(histogram)
    flat, counted = combos.ravel(), (combos > 0).astype(float).ravel()

    def pack(x):
        return np.bincount(flat, weights=np.repeat(x, 3) * counted, minlength=size)

    def back(r):
        return (r[flat] * counted).reshape(-1, 3).sum(axis=1)

    v = np.ones(len(combos))
    for _ in range(12):
        v = back(pack(v))
        norm = np.linalg.norm(v)
        v /= max(norm, 1e-30)
    rate = 1 / (norm * 1.05)
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0.0, y - rate * back(pack(y) - histogram))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x


def plan(histogram: np.ndarray, window: int = WINDOW, slack: int = SLACK) -> np.ndarray:
    """Rows ``length, first rank, per, first sequence, offset`` that place every piece once.

    The fitted counts are rounded down and used as far as the histogram allows, the largest first; what is
    left is packed greedily, the largest piece first and then whatever fits best, as long as that fills the
    window but for ``slack`` tokens. Pieces of a length that nothing completes any more are laid end to end and cut at the
    windows' edges: rows with ``per`` 0, of which piece k starts k lengths behind the row's place. The work
    depends on the number of lengths, not of pieces.
    """
    filling = Filling(histogram)
    left = filling.left
    lengths = np.flatnonzero(left)
    if len(lengths):
        combos = combinations(lengths, window)
        if len(combos):
            x = repeat_counts(combos, left.astype(float))
            for i in np.argsort(-x, kind="stable"):
                times = int(np.floor(x[i] + 1e-6))
                if times < 1:
                    break
                parts = [(int(v), int(n)) for v, n in zip(*np.unique(combos[i][combos[i] > 0], return_counts=True))]
                if (times := min(times, *[int(left[v]) // n for v, n in parts], times)) > 0:
                    filling.place(parts[::-1], times)
    laid = []
    present = [int(v) for v in np.flatnonzero(left)]
    while present:
        parts, room = [], window
        at = len(present)
        while room and at:
            at = min(at, bisect_right(present, room))
            if not at:
                break
            length = present[at - 1]
            per = min(int(left[length]), room // length)
            parts.append((length, per))
            room -= per * length
            at -= 1
        if room <= slack:
            filling.place(parts, min(int(left[v]) // n for v, n in parts))
            present = [v for v in present if left[v] > 0]
        else:
            laid.append(present.pop())
    end = filling.sequence * window
    for length in laid:
        filling.rows.append((length, filling.used[length], 0, end // window, end % window))
        end += int(left[length]) * length
    return filling.table()


def packed(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end: int = END, text_column: str = "text",
           id_column: str = "doc_id") -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``, one row per piece.

    Documents are cut at multiples of the window, and pieces that no others complete at the edge of a
    sequence. The histogram of piece lengths (at most ``window`` numbers) goes to the driver, the plan comes
    back; a piece's rank among those of its length is its number within its task plus the pieces of earlier
    tasks, so a length that a third of all pieces share needs no sort. Ids travel only with pieces of lengths
    that are cut. A sequence of whole pieces leaves at most ``SLACK`` tokens, of the others only the last one
    is shorter than the window; a null or empty text is its end id alone; equal rows are packed each; a null id
    stays null. Very long texts become as many pieces as they fill. Other columns are not read. Empty table: no rows.
    """
    rows = stored(pieces(docs, tokenizer or tokenizer_path("word_bpe_49k.json"), window, end, text_column, id_column), "pieces")
    table = plan(length_counts(rows, window), window)
    places = Places(table)
    cut = [int(v) for v in np.unique(table[table[:, 2] == 0, 0])]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    ids = F.when(F.col("length").isin(cut), F.col("ids")) if cut else F.lit(None).cast("binary")
    ranked = with_rank(rows.select(*names, "part", "nth", ids.alias("ids"))).select(*names, "rank", "ids")
    out = [*names, "sequence_id", "offset"]

    def run(batches):
        for b in batches:
            length = b.column(2).to_numpy()
            row, k = places.find(length, b.column(5).to_numpy())
            per, laid = np.maximum(row[:, 2], 1), row[:, 2] == 0
            place = row[:, 4] + np.where(laid, k, k % per) * length
            sequence = row[:, 3] + np.where(laid, place // window, k // per)
            place = np.where(laid, place % window, place)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(place)], names=out).filter(
                pa.array(place + length <= window))
            over = np.flatnonzero(place + length > window)
            if len(over):
                parts = []
                for i, row in zip(over.tolist(), b.take(pa.array(over)).to_pylist()):
                    first = int(window - place[i])
                    for s, e, sequence_id, offset in ((0, first, int(sequence[i]), int(place[i])), (first, row["length"], int(sequence[i]) + 1, 0)):
                        parts.append((row["doc_id"], row["start"] + s, e - s, zlib.crc32(row["ids"][s * 4:e * 4]), row["doc_tokens"], sequence_id, offset))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*parts)], names=out)

    return ranked.mapInArrow(run, ", ".join(f"{n} long" for n in out))
