"""Operator 13 against the patterns as stated, validators by hand, context, hostile texts and odd rows."""

import hashlib
import random
import re
import time

import pytest

from trajspark.llm import pii

STATED = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(int(p) <= 255 for p in t.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda t: 14 <= len(re.sub(r"[^0-9]", "", t)) <= 19 and sum(sum(map(int, str(int(c) * (1 + i % 2)))) for i, c in enumerate(re.sub(r"[^0-9]", "", t)[::-1])) % 10 == 0),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 10 <= len(re.sub(r"[^0-9]", "", t)) <= 15),
)


def stated(text):
    found = [(m.start(), k, m.end()) for k, (_, pattern, keep) in enumerate(STATED) for m in re.finditer(pattern, text) if keep(m[0])]
    return sorted(found)


def valid_card(rng, n):
    body = [rng.randrange(10) for _ in range(n - 1)]
    return next(c for d in range(10) if pii.luhn(c := "".join(map(str, body)) + str(d)))


def random_text(rng):
    parts = ["a.b@c.d", "x@y", "@", "a@b@c.de", "n_o@p-q.r.s_t@u.v", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "001.02.3.04", "+1 (555) 010-2000", "+12", "+49 30 1234567", "+1234567890123456", "é", "𝒳", " ", "\n", "-", ".", "9", "4111 1111 1111 1111", "ok", "%", "+", "(", "00"]
    return "".join(rng.choice(parts) if rng.random() < 0.8 else valid_card(rng, rng.randrange(13, 21)) for _ in range(rng.randrange(12)))


def test_base_spans_as_stated():
    rng = random.Random(13)
    for _ in range(4000):
        text = random_text(rng)
        found = pii.spans(text)
        assert [s[:3] for s in found if s[1] < len(pii.BASE)] == stated(text), text
        assert found == sorted(found) and all(0 <= s[3] <= 1 for s in found)


def test_validators_by_hand():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and pii.mod97("DE89370400440532013000") and not pii.mod97("GB82WEST12345698765433")
    one = lambda text: [(pii.KINDS[k], text[a:b]) for a, k, b, _ in pii.spans(text)]
    assert one("pay to GB82 WEST 1234 5698 7654 32 NOW") == [("iban", "GB82 WEST 1234 5698 7654 32")]
    assert one("pay to GB82 WEST 1234 5698 7654 33 now") == [] and one("XGB82WEST12345698765432") == [] and one("GB82WEST123456987654321") == []
    assert one("part 219-09-9999") == [] and one("her SSN is 219-09-9999.") == [("ssn", "219-09-9999")] and one("SSN 666-09-9999, 000-12-1234, 219-00-1234") == []
    assert one("call 415-555-0132 today") == [("tel", "415-555-0132")] and one("order 415-555-0132") == []
    assert one("call +1 415-555-0132") == [("phone", "+1 415-555-0132")]  # the base span takes the place


def test_context_moves_scores_and_drops_no_base_span():
    score = lambda text: pii.spans(text)[0][3]
    assert score("server address 10.1.2.3") > score("we saw 10.1.2.3") > score("version 10.1.2.3")
    assert len(pii.spans("version 10.1.2.3")) == 1


@pytest.mark.parametrize("piece", ["a", "a.", "1", "1.", "1 ", "+", "+1", "@", "a@", "a@b", "1-", "GB82 ", "GB82 WEST 1234 ", "+1 (", "219-09-", "0."])
def test_time_in_proportion(piece):
    def seconds(n):
        text = (piece * n)[:n]
        start = time.perf_counter()
        pii.spans(text)
        return time.perf_counter() - start

    seconds(1000)
    a, b = (min(seconds(n) for _ in range(2)) for n in (20_000, 160_000))
    assert b < 30 * a + 0.1


def test_odd_rows_redaction_and_digest(spark):
    long_text = "x" * 300_000 + " mail me@host.example.org " + "7" * 200_000
    rows = [(1, None, 0, "a"), (2, "", 0, "b"), (3, "call +1 415-555-0132 or a@b.co", 30, "c"), (3, "call +1 415-555-0132 or a@b.co", 30, "c"), (None, "𝒳 10.0.0.1", 10, "d"), (4, long_text, len(long_text), "e"), (5, "nothing here", 12, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, found string")
    got = pii.find_personal(docs)
    assert got.columns == ["doc_id", "text", "n_chars", "found"] and got.count() == len(rows)
    d = pii.digest(got).orderBy("doc_id").collect()
    by = {r["doc_id"]: r for r in d}
    assert by[3]["spans"] == "phone:5:20,email:24:30" and by[3]["n_email"] == by[3]["n_phone"] == 1 and len(d) == len(rows)
    assert by[3]["base_sha256"] == hashlib.sha256(b"phone:5:20,email:24:30").hexdigest() and by[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert by[None]["spans"] == "ip:2:10" and by[4]["spans"] == "email:300006:300025" and by[1]["spans"] == by[2]["spans"] == by[5]["spans"] == ""
    clean = {(r["doc_id"], r["text"], r["n_chars"], r["found"]) for r in pii.redact(docs).collect()}
    assert (3, "call [PHONE] or [EMAIL]", 23, "c") in clean and (1, None, 0, "a") in clean and (None, "𝒳 [IP]", 6, "d") in clean and (5, "nothing here", 12, "f") in clean
    assert pii.digest(pii.find_personal(docs.limit(0))).count() == 0 and pii.redact(docs.limit(0)).count() == 0
