"""Personal data: base spans by plain regular expressions, checksums, context, redaction."""

import random
import re

from cohortlens.llm import pii

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _base(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(d) <= 19 and sum(
                    (v * 2 - 9 if v > 4 else v * 2) if i % 2 else v for i, v in enumerate(map(int, d[::-1]))) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), list(PLAIN).index(kind), kind, m.end()))
    return [(k, s, e) for s, _, k, e in sorted(out)]


def test_base_spans_by_plain_patterns():
    rng = random.Random(4)
    pieces = ["a@b.c", "x.y@d-e.f.g", "@", ".", "_", "1.2.3.4", "300.1.1.1", "01.002.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112",
              "+1 (415) 555-2671", "+49.30", "+", " ", "-", "  ", "é", "9", "12", "\n", "a@b", "q@r.s_t@u.v", "5", "(", ")", "٣"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        got = [(s["kind"], s["start"], s["end"]) for s in pii.spans(text) if s["kind"] in pii.BASE]
        assert got == _base(text), text


def test_checksums_and_context():
    found = {s["kind"]: s for s in pii.spans("IBAN DE89 3704 0044 0532 0130 00 and ssn 123-45-6789, call 212-555-0187")}
    assert set(found) == {"iban", "ssn", "local"}
    assert not pii.spans("DE89 3704 0044 0532 0130 01, 123-45-6789 and 212-555-0187")
    near, far = pii.spans("credit card 4111111111111111")[0], pii.spans("isbn 4111111111111111")[0]
    assert near["score"] > far["score"]


def _iban(country, rest):
    number = int("".join(str(int(c, 36)) for c in rest + country + "00"))
    return f"{country}{98 - number % 97:02d}{rest}"


def _ibans(text):
    return [text[s["start"]:s["end"]] for s in pii.spans(text) if s["kind"] == "iban"]


def test_ibans_among_other_tokens():
    de, gb = "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"
    for text, want in ((f"{de} BIC COBADEFFXXX", [de]), (f"{de} {gb}", [de, gb]), (f"{gb} {de} 42", [gb, de]),
                       (f"PAY TO {gb} BEFORE FRIDAY", [gb]), (f"AB12 {de} X", [de]), (f"{gb}X {gb[:-1]}", [])):
        assert _ibans(text) == want, text
    other = _iban("ZZ", "ABCD1234567890123")
    assert _ibans(f"see {other}, {other}X") == [other]
    assert pii.redact(f"{de} BIC X", pii.spans(f"{de} BIC X")) == "[IBAN] BIC X"


def test_an_iban_stays_beside_a_card():
    both = [x for x in (_iban("BE", f"{n:012d}") for n in range(539007547000, 539007547200)) if pii.luhn(x[2:])]
    assert both
    for x in both:
        text = f"to {x} now"
        assert [s["kind"] for s in pii.spans(text)] == ["iban", "card"]
        assert pii.redact(text, pii.spans(text)) == "to [IBAN] now"


def test_many_iban_heads_take_linear_time():
    for text in ("AB12 " * 10_000, "DE89 " * 10_000, "AB12 C " * 7_000):
        pii.spans(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1 " * 100_000, "a@" * 150_000, "1 " * 150_000, "A1" * 150_000):
        pii.spans(text)


def test_rows_and_redaction(spark):
    rows = [(1, "mail me: ann@x.org, ok", 5), (2, None, 6), (None, "", 7), (1, "mail me: ann@x.org, ok", 5), (4, "clean", 8)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, c0 long")
    out = pii.personal_data(frame).collect()
    assert sorted((r.doc_id or 0, len(r.spans)) for r in out) == [(0, 0), (1, 1), (1, 1), (2, 0), (4, 0)]
    hidden = pii.redacted(frame)
    assert hidden.columns == ["text", "doc_id", "c0"] or set(hidden.columns) == set(frame.columns)
    assert {(r.doc_id, r.text, r.c0) for r in hidden.collect()} == {
        (1, "mail me: [EMAIL], ok", 5), (2, None, 6), (None, "", 7), (4, "clean", 8)}
    assert pii.personal_data(frame.limit(0)).count() == 0
