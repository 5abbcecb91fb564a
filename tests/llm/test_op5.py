import hashlib
import re

from orrery.llm.pii import find_pii, luhn, masked
from orrery.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[ -]?[0-9])+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 16 <= len(digits) <= 19 and sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0, "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


TEXTS = [None, "", "é a.b@c.d.e, x@y 1.2.3.4.5 256.1.1.1 1.2.3.256 00000001.2.3.4", "4918187128635271 and 4918-1871 2863-5271 4918187128635272", "+1 (578) 555-6437 +12 +1234567890123456 call 555 123 4567", 'token = "a038f8b93202544b5d4b500d8cce257d12d61a70" password=68d10f12e5811ede71', "x" * 100000 + " 10.0.0.1", "1.2.3.4 ٣٤ ４"]


def test_base_spans(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, TEXTS[2], "x"), (1, TEXTS[3], "x"), (1, TEXTS[3], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = find_pii(docs, carry=True).select("document.text", "spans").collect()
    assert len(got) == len(rows)
    for text, spans in got:
        assert [(s["kind"], s["start"], s["end"]) for s in spans if s["base"]] == brute(text)
    assert find_pii(docs.limit(0)).count() == 0


def test_query_on_sample(spark):
    texts = dict(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    for r in QUERIES["op5_pii"](spark, SMALL).collect():
        want = brute(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(k == x[0] for x in want) for k in PATTERNS]
        assert set(f"{k}:{s}:{e}" for k, s, e in want) <= set(r["spans"].split(","))


def test_weak_labels_find_secrets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    hit = want = 0
    for text, spans in find_pii(docs).select("text", "spans").collect():
        known = {m.span(1) for m in re.finditer(r'(?:token = "|password=)([0-9a-f]+)', text)}
        found = {(s["start"], s["end"]) for s in spans if s["kind"] == "secret"}
        want += len(known)
        hit += len(known & found)
        assert all(any(c.isdigit() for c in text[a:b]) for a, b in found)
    assert want and hit >= 0.9 * want


def test_masks():
    assert masked("a b@c.d 1", [("email", 2, 7), ("number", 3, 9)]) == "a [EMAIL]"
    assert luhn("4918187128635271") and not luhn("4918187128635272")


def test_long_and_letters_only_secrets(spark):
    signature = "".join(hashlib.sha256(bytes([i])).hexdigest().replace("a", "K").replace("3", "-") for i in range(6))[:342]
    new = {-1: (f'token = "{signature}"', signature), -2: ("login with password=correcthorsebatterystaple now", "correcthorsebatterystaple"), -3: ("well-established internationalization", None)}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(k, t) for k, (t, _) in new.items()], docs.schema))
    for r in find_pii(docs, redact=False).where("doc_id < 0").collect():
        text, secret = new[r["doc_id"]]
        assert [text[s["start"] : s["end"]] for s in r["spans"] if s["kind"] == "secret"] == ([secret] if secret else [])


def test_long_texts_take_linear_time():
    """A megabyte of letters, digits, dots, at signs or signs of a phone, and what it does to leftmost matches."""
    import time

    from orrery.llm.pii import BASE, _valid, base_spans, candidates

    n = 1_000_000
    for body in ("a" * n + "@b.co", "1" * n, "1." * (n // 2), "a@" * (n // 2), "+1 " * (n // 3), "1 2-" * (n // 4), "x" * n + " 10.2.3.4 " + "9" * n, "a.b-" * (n // 4) + "@"):
        began = time.perf_counter()
        found = base_spans(body)
        assert time.perf_counter() - began < 4, body[:20]
        list(candidates(body, [x for v in found.values() for x in v]))
        assert time.perf_counter() - began < 8, body[:20]
    import random

    rng = random.Random(2)
    for _ in range(3000):
        body = "".join(rng.choice("aB1239.@-+ %)é_") for _ in range(rng.randrange(60)))
        assert base_spans(body) == {k: [m.span() for m in p.finditer(body) if _valid(k, m[0])] for k, p in BASE.items()}, body
