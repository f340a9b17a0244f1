import math
import random
import re

from quarry.llm import licenses

SCHEMA = "doc_id long, text string, row string, pad string, labels int"


def brute(text, threshold=0.9, block=64, step=32):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    places, base = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    labels, share = set(base), 1.0 if places else 0.0
    for start in range(0, max(1, len(words)), step):
        held = set(words[start : start + block])
        for label, text_of in licenses.TEMPLATES:
            t = set(text_of.split())
            if len(t & held) >= math.ceil(threshold * len(t) - 1e-9):
                labels.add(label)
                share = max(share, len(t & held) / len(t))
    j = lambda x: ",".join(sorted(x))
    return len(words), len(places), min(places, default=None), max(places, default=None), j(base), j(labels), round(share, 9)


def check(df):
    rows = df.collect()
    want = sorted(map(str, ((r.doc_id, *brute(r.text)) for r in rows)))
    got = licenses.scan_licenses(df).collect()
    assert sorted(str((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9))) for r in got) == want


def test_against_brute_force(spark, sf_dir):
    rng = random.Random(6)
    vocabulary = [w for _, t in licenses.TEMPLATES for w in t.split()] + ["filler", "Ça", "x1"]
    rows = []
    for i in range(300):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 120))]
        for _ in range(rng.randrange(3)):
            t = rng.choice(licenses.TEMPLATES)[1].split()
            if rng.random() < 0.5:
                t.pop(rng.randrange(len(t)))
            words[rng.randrange(len(words) + 1) :] = t
        rows.append((i, rng.choice([" ", "\n", "--", " | "]).join(words), "", "", 0))
    rows += [(900, None, "", "", 0), (901, "", "", "", 0), (902, "...", "", "", 0), (903, "cc by cc by CC-BY. all rights reserved", "", "", 0), (904, "by cc ccby é by", "", "", 0), (905, "cc by " * 20_000, "", "", 0), (None, "All rights reserved.", "", "", 0), (None, "All rights reserved.", "", "", 0)]
    check(spark.createDataFrame(rows, SCHEMA))
    check(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def test_long_templates(spark):
    rng = random.Random(7)
    templates = tuple((f"t{n}", " ".join(f"w{n}x{k}" for k in range(n))) for n in (33, 50, 80, 400))
    rows = []
    for i in range(60):
        before = ["filler"] * rng.randrange(0, 200)
        own = templates[i % 4][1].split()
        for _ in range(len(own) // 12):
            own[rng.randrange(len(own))] = "other"
        rows.append((i, " ".join([*before, *own, *["filler"] * rng.randrange(0, 100)]), "", "", 0))
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, SCHEMA), templates, 0.9).collect()}
    for i, text, *_ in rows:
        words = set(templates[i % 4][1].split())
        share = len(words & set(text.split())) / len(words)
        assert got[i].labels == (templates[i % 4][0] if share >= 0.9 else "")
        assert abs(got[i].score - share) < 1e-9 or share < 0.9


def test_empty_table(spark):
    assert licenses.scan_licenses(spark.createDataFrame([], SCHEMA)).count() == 0
