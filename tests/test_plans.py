"""Every query against its SQL in DuckDB, on the small tables."""

import hashlib
import os
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from quarry import plans
from quarry.operators import chunking as K
from quarry.operators import vectors as V
from quarry.sources import adapters as A

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return c


def plain(value):
    if isinstance(value, float):
        return round(value, 5)
    return str(value) if isinstance(value, (list, dict)) else value


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_same_rows_as_sql(spark, sf_dir, duck, name):
    df = plans.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=str)
    run = duck.execute(plans.ORACLES[name])
    names = [d[0] for d in run.description]
    assert sorted(names) == columns
    want = sorted(([plain(r[names.index(c)]) for c in columns] for r in run.fetchall()), key=str)
    assert got == want


def test_those_without_sql_have_tests_of_their_own():
    assert set(plans.QUERIES) - set(plans.ORACLES) == {"tx2_redact_full", "tx3_optimize", "ag8_redaction_stats", "ag10_chunk_stats", "tx6_find_similar_code"}


def found_secrets(text, path):
    """Secrets by plain rules: each pattern alone, then what looks harmless goes; a mask for each character covered."""
    out, low = [], text.lower()
    near = lambda a, b, words: any(w in low[max(0, a) : b] for w in words)
    signs = [p for end, patterns in K.COMMENTS.items() if path.lower().endswith(end) for p in patterns]
    for name, kind, confidence, context, pattern in K.PATTERNS:
        if confidence < 0.5:
            continue
        for m in re.finditer(pattern, text, 0 if kind == "private_key" else re.IGNORECASE):
            a, b = m.span()
            line = text[text.rfind("\n", 0, a) + 1 : text.find("\n", a) if "\n" in text[a:] else len(text)]
            harmless = (confidence < 0.7 and b - a < 16) or near(a, b, K.PLACEHOLDERS) or near(a - 100, a + 100, K.EXAMPLES) or any(re.search(s, line, re.DOTALL) for s in signs)
            if not harmless and (not context or near(a - 50, b + 50, K.SUSPICIOUS)):
                out.append((a, b, name, kind, confidence))
    return sorted(out, key=lambda f: f[0])


def test_redaction_of_all_files(spark, sf_dir):
    files = {r.id: r for r in A.files(spark, sf_dir).select("id", "file_path", "description").collect()}
    got = {r.id: r for r in plans.QUERIES["tx2_redact_full"](spark, sf_dir).collect()}
    assert set(got) == {i for i, r in files.items() if K._redacts(r.file_path)}
    names = Counter()
    for i, r in got.items():
        text, found = files[i].description or "", found_secrets(files[i].description or "", files[i].file_path)
        assert (r.redactions, sorted(r.names.split(",")) if r.names else [], r.high_confidence) == (len(found), sorted(f[2] for f in found), sum(f[4] >= 0.8 for f in found))
        masked = list(text)
        for a, b, _, kind, _ in reversed(found):
            masked[a:b] = f"[REDACTED:{kind.upper()}]"[: b - a].ljust(b - a, "X")
        assert r.redacted_hash == hashlib.sha256("".join(masked).encode()).hexdigest()
        names.update(f[2] for f in found)
    kinds = {p[0]: (p[1], p[2] >= 0.8) for p in K.PATTERNS}
    want = sorted((kinds[n][0], n, c, c * kinds[n][1]) for n, c in names.items())
    assert sorted((r.type, r.name, r.redactions, r.high_confidence) for r in plans.QUERIES["ag8_redaction_stats"](spark, sf_dir).collect()) == want


def test_chunks_of_all_files(spark, sf_dir):
    files = {r.id: r for r in A.files(spark, sf_dir).select("id", "file_path", "description").collect()}
    chunks = defaultdict(list)
    for r in plans.QUERIES["tx3_optimize"](spark, sf_dir).collect():
        chunks[r.id].append(r)
    squeeze = lambda t: re.sub(r"\s+", "", t)
    whole = K.chunk_files(A.files(spark, sf_dir)).collect()
    parts = defaultdict(list)
    for r in sorted(whole, key=lambda r: (r.id, r.chunk_index)):
        assert len(r.content) <= 1500 or "\n" not in r.content.strip()[:1500] or r.how in ("split", "")
        assert 1 <= r.start_line <= r.end_line
        parts[r.id].append(r.content)
    assert set(chunks) == set(parts) == {i for i, r in files.items() if (r.description or "").strip(" ")and squeeze(r.description)}
    for i, own in parts.items():  # but for white space and secrets nothing is lost, and nothing stands twice
        assert [r.chunk_index for r in sorted(chunks[i], key=lambda r: r.chunk_index)] == list(range(len(own)))
        text = squeeze("".join(own))
        if not any(r.redacted for r in chunks[i]) and "[REDACTED:" not in text:
            assert text == squeeze(files[i].description)
    stats = plans.QUERIES["ag10_chunk_stats"](spark, sf_dir).collect()
    assert sum(r.chunks for r in stats) == len(whole) and sum(r.files for r in stats) == len(parts)
    assert sum(r.redacted for r in stats) == sum(r.redacted for r in whole)
    assert sum(r.joined for r in stats) == sum(r.how == "combined" for r in whole) and sum(r.split for r in stats) == sum(r.how.startswith("split") for r in whole)


def test_similar_code_among_all_files(spark, sf_dir):
    rows = sorted(V.embed(K.chunk_files(A.files(spark, sf_dir)), 64).collect(), key=lambda r: (r.file_path, r.chunk_index))
    asked = np.array(next(r.vector for r in rows if r.chunk_index == 0))
    vectors = np.array([r.vector for r in rows])
    similarity = vectors @ asked / np.maximum(np.linalg.norm(vectors, axis=1) * np.linalg.norm(asked), 1e-12)
    got = plans.QUERIES["tx6_find_similar_code"](spark, sf_dir).collect()
    place = {(r.file_path, r.start_line, r.end_line): s for r, s in zip(rows, similarity, strict=True)}
    best = sorted(similarity, reverse=True)[:40]
    assert 0 < len(got) <= 20 and [r.similarity for r in got] == sorted((r.similarity for r in got), reverse=True)
    assert got[0].similarity == pytest.approx(best[0], abs=1e-6)
    for r in got:
        assert r.similarity >= best[-1] - 1e-6 and r.similarity >= 0.5
        assert any(abs(s - r.similarity) < 1e-6 for k, s in place.items() if k[0] == r.file_path)
