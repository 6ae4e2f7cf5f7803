import random
import re

import pytest

from leafscore.llm.pii import KINDS, find_pii, find_spans, luhn, mod97, redact

PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
NAMES = list(KINDS)


def brute(text):
    found = []
    for k, (name, pattern) in enumerate(PATTERNS.items()):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": name == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                  "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[name]
            if ok:
                found.append((m.start(), k, m.end()))
    return sorted(found)


@pytest.mark.parametrize("alphabet", ["a@.-_1 ", "1.2 ", "+1( )-.9 ", "0123456789 -", "a1@.+ (-)%2 5é\n", "0123456789"])
def test_base_spans_match_the_plain_patterns(alphabet):
    rng = random.Random(alphabet)
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert [(s, k, e) for s, k, e, _ in find_spans(text, 40, 0.6, 0.4) if KINDS[NAMES[k]].base] == brute(text)


def test_checksums():
    assert luhn("4111111111111111") and not luhn("4111111111111112")
    assert mod97("GB82WEST12345698765432") and not mod97("GB82WEST12345698765431")


def test_other_kinds_need_their_checks_and_context():
    def kinds(text):
        return [NAMES[k] for _, k, _, _ in find_spans(text, 40, 0.6, 0.4)]

    assert "iban" in kinds("IBAN GB82 WEST 1234 5698 7654 32.") and "iban" not in kinds("IBAN GB82 WEST 1234 5698 7654 33.")
    assert "ssn" in kinds("social security 123-45-6789") and "ssn" not in kinds("part 123-45-6789")


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000 + " x@y.zz", "1" * 300_000, "1." * 150_000, "+1" + "-" * 300_000, "1 " * 150_000, "@" * 200_000, "a@" * 100_000):
        find_spans(text, 40, 0.6, 0.4)


def test_spans_are_code_points_and_odd_rows_have_none(make, odd_rows):
    docs = make(odd_rows + [(50, "é字 me@site.org, 字")])
    found = {r.doc_id: r.spans for r in find_pii(docs).collect()}
    assert [(s.kind, s.start, s.end) for s in found[50]] == [("email", 3, 14)]
    assert all(not found[k] for k in (1, 2, 3, 6, 7, 8, 9))
    assert {r.doc_id: r.redacted for r in redact(docs).collect()}[50] == "é字 [EMAIL], 字"
    assert find_pii(make([])).count() == 0 and find_pii(docs).count() == len(odd_rows) + 1


@pytest.mark.parametrize("after", [" BIC COBADEFFXXX", " I wrote", " 12 TIMES", " GB82 WEST 1234 5698 7654 32", ".", ""])
def test_accounts_are_found_whatever_follows(after):
    number = "DE89 3704 0044 0532 0130 00"
    found = [(s, e) for s, k, e, _ in find_spans(f"IBAN {number}{after}", 40, 0.6, 0.4) if NAMES[k] == "iban"]
    assert found[0] == (5, 5 + len(number)) and len(found) == 1 + ("GB82" in after)
    assert not any(NAMES[k] == "iban" for _, k, _, _ in find_spans("IBAN DE88 3704 0044 0532 0130 00", 40, 0.6, 0.4))
