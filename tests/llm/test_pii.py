import hashlib
import random
import re

from quarry.llm import pii

SCHEMA = "doc_id long, text string, row string, spans string, n_email int"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def ok(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    return kind == "email" or 9 <= len(d) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if ok(k, m.group())]


def check(df):
    got = pii.find_private(df).collect()
    rows = df.collect()
    assert len(got) == len(rows)
    want = sorted((str(r.doc_id), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in brute(r.text)).encode()).hexdigest()) for r in rows)
    assert sorted((str(r.doc_id), r.base_sha256) for r in got) == want
    texts = {r.doc_id: r.text for r in rows}
    for r in got:
        spans = [s.rsplit(":", 2) for s in r.spans.split(",")] if r.spans else []
        base = [(k, int(a), int(b)) for k, a, b in spans if k in pii.BASE]
        assert len(base) == r.n_email + r.n_ip + r.n_card + r.n_phone
        if r.doc_id is not None:
            assert base == brute(texts[r.doc_id])
    return got


def test_base_spans_against_brute_force(spark):
    rng = random.Random(4)
    bits = ["a@b.co", "@", "x.y+z@", "é", "𝔞", " ", "\n", ".", "-", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "+1 (385) 555-1563", "+", "(", "0", "99", "4111-1111-1111-1112", "_", "a@b.c_d@e.f", ".5.6.7.8", "007.0.0.1", "5"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(0, 40))), "", "", 0) for i in range(400)]
    rows += [(400, None, "", "", 0), (401, "", "", "", 0), (402, "a" * 100_000, "", "", 0), (403, "a@b" + ".c" * 20_000, "", "", 0), (404, "1" * 50_000, "", "", 0), (405, "1.2.3.4 " * 3000, "", "", 0), (None, "me@x.org", "", "", 0), (406, "+1" + " " * 30_000, "", "", 0)]
    check(spark.createDataFrame(rows, SCHEMA))


def test_documents_and_repeated_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(docs)
    one = spark.createDataFrame([(1, "write to me@x.org", "", "", 0)] * 2, SCHEMA)
    assert [r.spans for r in pii.find_private(one).collect()] == ["email:9:17"] * 2
    assert pii.find_private(one.limit(0)).count() == 0


def test_added_spans(spark):
    prose = [(i, "plain words that say nothing about anyone at all", "", "", 0) for i in range(50)]
    rows = [(100 + i, f"my api token = \"{hashlib.sha1(str(i).encode()).hexdigest()}\" is set", "", "", 0) for i in range(30)]
    rows += [(200 + i, f"call {200 + i}-555-{1000 + i} now", "", "", 0) for i in range(30)]
    got = {r.doc_id: r.spans for r in pii.find_private(spark.createDataFrame(prose + rows, SCHEMA)).collect()}
    assert all(got[i] == "" for i in range(50))
    assert all(got[100 + i] == "secret:16:56" for i in range(30))
    assert sum(got[200 + i].startswith("tel:5:") for i in range(30)) == 30


def test_recall_and_precision_of_added_spans(spark):
    rng = random.Random(12)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9)))
    make = {
        "iban": lambda: f"DE{digits(20)}",
        "mail": lambda: f"{word()} at {word()} dot com",
        "secret": lambda: "ghp_" + "".join(rng.choice("abcdefXYZ0123456789") for _ in range(35)) + "7",
        "ssn": lambda: f"{rng.randrange(100, 600)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}",
        "tel": lambda: f"({rng.randrange(200, 299)}) {rng.randrange(200, 999)}-{digits(4)}",
    }
    lead = {"iban": "konto", "mail": "write to", "secret": "api key", "ssn": "social security number", "tel": "call"}
    decoys = [lambda: f"order {rng.randrange(900, 999)}-{digits(2)}-{digits(4)}", lambda: f"XX{digits(2)} {digits(4)} {digits(4)}", lambda: f"page 100.{digits(3)}.{digits(4)}", lambda: f"sha1 checksum 1{digits(39)}"]
    rows, want = [], set()
    for i in range(600):
        text = f"{word()} {word()} "
        for _ in range(rng.randrange(3)):
            if rng.random() < 0.6:
                kind = rng.choice(list(make))
                span = make[kind]()
                text += f"{lead[kind]} " if rng.random() < 0.8 else f"{word()} "
                want.add((i, kind, len(text), len(text) + len(span)))
                text += f"{span} , {word()} "
            else:
                text += f"{rng.choice(decoys)()} , {word()} "
        rows.append((i, text, "", "", 0))
    got = set()
    for r in pii.find_private(spark.createDataFrame(rows, SCHEMA)).collect():
        got |= {(r.doc_id, k, int(a), int(b)) for k, a, b in (x.rsplit(":", 2) for x in r.spans.split(",") if x) if k in pii.MORE}
    recall, precision = len(got & want) / len(want), len(got & want) / len(got)
    assert recall > 0.9 and precision > 0.9


def test_estimation_finds_the_reliable_labelers():
    counts = [("tel", (1, 1, 1, 1, 0), 80), ("tel", (1, 1, 0, 1, 0), 40), ("tel", (1, -1, 0, -1, -1), 60), ("tel", (-1, -1, 0, -1, 0), 30)]
    prob = pii.estimate(counts)
    assert prob["tel", (1, 1, 1, 1, 0)] > 0.9 > 0.1 > prob["tel", (-1, -1, 0, -1, 0)]
