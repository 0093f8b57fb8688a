import random
import re

from gleanery.llm import pii
from tests.llm.helpers import docs_of, noisy, rows_of

FORMS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def brute(text):
    out = []
    for kind, form in FORMS.items():
        for m in form.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 13 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def base(text):
    return [s for s in pii.find_spans(text) if s[0] in pii.BASE_KINDS]


def test_base_spans_equal_the_patterns_on_random_texts():
    rng = random.Random(5)
    alphabet = "aZ0123456789@.+-() é_%1.2@"
    for _ in range(20_000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
        assert base(text) == brute(text), text


def test_known_cases():
    text = "mail a.b@c.example.org, 10.0.0.255, 4190 6097 3268 7108, +1 (867) 555-2364; 1.2.3.256"
    assert [text[a:b] for _, a, b in base(text)] == ["a.b@c.example.org", "10.0.0.255", "4190 6097 3268 7108", "+1 (867) 555-2364"] and base(text) == brute(text)
    assert base("😀 x@y.z") == [("email", 2, 7)]
    assert pii.find_spans(None) == pii.find_spans("") == []


def test_added_spans_need_a_cue_and_validate():
    assert pii.find_spans("IBAN: DE89 3704 0044 0532 0130 00") [-1][0] == "iban"
    assert not [s for s in pii.find_spans("IBAN DE88 3704 0044 0532 0130 00") if s[0] == "iban"]
    assert ("account", 12, 20) in pii.find_spans("account no. 12345678 is closed")
    assert [s[0] for s in pii.find_spans("ftp://bob:secret@host/x")] == ["login"]
    assert pii.find_spans("the account of the year 2001 was clean") == []


def test_table_and_redaction(spark):
    texts = [None, "", "x@y.zz " * 3000, "clean"]
    for df in (docs_of(spark, texts), noisy(docs_of(spark, texts))):
        found = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in rows_of(pii.pii_spans(df))}
        assert found == {i + 1: pii.find_spans(t) for i, t in enumerate(texts)}
    cut = {r["doc_id"]: r["text"] for r in rows_of(pii.redact(docs_of(spark, ["to x@y.zz now", None, "clean"])))}
    assert cut == {1: "to [EMAIL] now", 2: None, 3: "clean"}
    assert rows_of(pii.pii_spans(docs_of(spark, []))) == []
