import hashlib
import random
import re
import secrets
import sqlite3

import pytest
from pyspark.sql import functions as F

from quarry.functions.text import token_estimate
from quarry.operators import batches as B
from quarry.operators import catalog as C
from quarry.operators import chunking as K
from quarry.operators import metrics as M
from quarry.operators import search as S
from quarry.operators import tree as T
from quarry.operators.folds import placed
from quarry.operators import vectors as V
from quarry.sources import listing as L
from quarry.sources.folders import walk_files

FILES = "id long, project_id string, file_path string, description string, to_be_cleaned long"


def make_files(spark, rows):
    return spark.createDataFrame([(i, p, f, d, None) for i, (p, f, d) in enumerate(rows, 1)], FILES)


@pytest.mark.parametrize("query", ["module", "utility functions", '"feature set"', "grpc proto", '"set 1" module', "p1", "ÉCOLE", "user_id", '"set set"', "Žluťoučký", "ΆΝΘΡΩΠΟΣ", "ſtraße"])
def test_bm25_against_fts5(spark, query):
    rng = random.Random(1)
    words = ["module", "utility", "functions", "feature", "set", "1", "grpc", "proto", "école", "user_id", "handler", "žluťoučký", "z\u030clut\u030couc\u030cky\u0301", "άνθρωπος", "STRAßE"]
    rows = [(f"p{k % 3}", f"src/m_{k}.py", " ".join(rng.choice(words) for _ in range(rng.randrange(1, 30)))) for k in range(120)]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(project_id, file_path, description)")
    db.executemany("INSERT INTO t VALUES (?, ?, ?)", rows)
    match = " AND ".join(f'"{" ".join(p)}"' for p in S.query_phrases(query))
    want = {r: s for r, s in db.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (match,))}
    got = {r.id: r.score for r in S.search(make_files(spark, rows), query, limit=500).collect()}
    assert got == pytest.approx(want)


def test_letters_fold_as_fts5_folds_them(spark):
    """All letters that Unicode composes of a letter and marks: the same tokens."""
    from unicodedata import category, normalize

    from quarry.functions.text import padded_tokens

    letters = [c for c in map(chr, range(0x80, 0x10000)) if category(c)[0] == "L" and len(normalize("NFD", c)) > 1 and not "\uac00" <= c <= "\ud7a3"]
    texts = [f"x{c}y {normalize('NFD', c)}" if len(normalize("NFD", c)) == 2 and normalize("NFD", c)[0].isascii() else f"x{c}y" for c in letters]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(x)")
    db.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", enumerate(texts))
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    want = {}
    for term, row, _, at in db.execute("SELECT term, doc, col, offset FROM v"):
        want.setdefault(row, {})[at] = term
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string").select("k", padded_tokens(F.col("t")).alias("p")).collect()
    assert len(rows) > 900
    for r in rows:
        own = [t for _, t in sorted(want[r.k].items())]
        assert r.p.split() == own == [t for p in S.query_phrases(texts[r.k]) for t in p], (r.k, texts[r.k])


def test_statistics_cover_deleted_files(spark):
    rows = [("p", f"f{k}.py", "alpha beta" if k % 3 else "alpha") for k in range(12)]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(project_id, file_path, description)")
    db.executemany("INSERT INTO t VALUES (?, ?, ?)", rows)
    want = {r: s for r, s in db.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH 'beta'") if r % 4}
    files = make_files(spark, rows).withColumn("to_be_cleaned", F.when(F.col("id") % 4 == 0, 5))
    assert {r.id: r.score for r in S.search(files, "beta", limit=500).collect()} == pytest.approx(want)
    queries = spark.createDataFrame([(1, ["beta"]), (2, ["alpha", "nowhere"])], "query_id long, terms array<string>")
    assert {(r.query_id, r.id): r.score for r in S.search_many(files, queries, 500).collect()} == pytest.approx({(1, i): s for i, s in want.items()})


def test_search_corpora(spark):
    f = make_files(spark, [("p", "grpc_server.py", "grpc server implementation with proto message handling"), ("p", "proto_handler.py", "proto message handler with grpc communication"), ("q", "auth.py", "Authentication and authorization module")])
    paths = lambda q, **o: {r.file_path for r in S.search(f, q, **o).collect()}
    assert paths("grpc proto") == paths("proto grpc") == {"grpc_server.py", "proto_handler.py"}
    assert paths("authentication") == {"auth.py"} and paths("authentication", project_id="p") == set()
    assert paths("") == paths('x ""') == paths("++") == set()


def test_postings_agree_with_single_searches(spark, sf_dir):
    from quarry.sources.adapters import files

    f = files(spark, sf_dir)
    queries = spark.createDataFrame([(1, ["the", "and"]), (2, ["license"])], "query_id long, terms array<string>")
    many = S.search_many(f, queries, 10).collect()
    for q, text in ((1, "the and"), (2, "license")):
        alone = [(r.id, round(r.score, 9)) for r in S.search(f, text, limit=10).collect()]
        assert [(r.id, round(r.score, 9)) for r in sorted(many, key=lambda r: r.rank) if r.query_id == q] == alone


def test_line_chunks_in_both_forms(spark):
    rng = random.Random(2)
    texts = ["\n".join(rng.choice(["", "  ", "code", "x = 1"]) for _ in range(rng.randrange(0, 200))) for _ in range(60)] + ["", "\n\n\n", "a", "a\n" * 120]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").select("id", K.line_chunks(F.col("t")).alias("c"))
    for r in df.collect():
        assert [tuple(c) for c in r.c] == K.cut_lines(texts[r.id])


def fake_secrets():
    up = lambda n: "".join(secrets.choice("ABCDEFGHIJKLMNOPQRSTUVW23456789") for _ in range(n))
    return {"aws_access_key": "AKIA" + up(16), "github_token": "ghp_" + up(36), "google_api_key": "AIza" + up(35), "slack_token": "xoxb-" + up(20), "postgres_url": f"postgres://u:{up(12)}@h/db", "url_with_credentials": f"https://u:{up(9)}@h.org/x", "jwt_token": f"eyJ{up(9)}.eyJ{up(9)}.{up(9)}"}


def test_redaction(spark):
    r = K.Redactor()
    for name, secret in fake_secrets().items():
        text = f"value = '{secret}' done"
        masked, found = r.redact(text, "src/a.rb")
        assert name in {f.name for f in found}
        assert secret not in masked and len(masked) == len(text) and masked.startswith("value = '") and "[REDACTED:" in masked
    assert r.redact("password = hunter2hunter2hunter2", "a.rb")[1][0].name == "env_password"
    assert r.redact("password = your_password_here_now", "a.rb")[1] == []
    assert r.redact(f"k = 'AKIA{'QRSTUVWZ' * 2}'  # note", "a.py")[1] == []
    assert r.redact("for example " + fake_secrets()["github_token"], "a.rb")[1] == []
    key = "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----"
    assert r.redact(key, None)[1][0].name == "rsa_private_key"
    low = {p[0] for p in K.PATTERNS if p[2] < 0.5}
    assert low == {"base64_encoded", "hex_encoded", "uuid"} and len(K.PATTERNS) == 23
    paths = {"a.md": False, "x/test_a.py": False, "docs/a.py": False, "src/a.py": True, ".md": True}
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", K.needs_redaction(F.col("p")).alias("n")).collect()
    assert {x.p: x.n for x in rows} == {p: K._redacts(p) for p in paths} == paths


def test_joining_and_splitting():
    small = [K.Chunk("a", 1, 1), K.Chunk("b", 3, 4, True), K.Chunk("c" * 60, 5, 9), K.Chunk("d", 10, 10)]
    joined = K.join_small(small)
    assert [(c.content, c.start_line, c.end_line, c.redacted, c.name) for c in joined] == [("a\n\nb", 1, 4, False, "combined_2_chunks"), ("c" * 60, 5, 9, False, None), ("d", 10, 10, False, None)]
    assert K.split_large(K.Chunk("x" * 1500, 1, 1)) == [K.Chunk("x" * 1500, 1, 1)]
    parts = K.split_large(K.Chunk("def f():\n" + "y = 1\n" * 300 + "}\nz = 2", 10, 312))
    assert [p.how for p in parts] == ["split", *["split_size"] * (len(parts) - 2), "split"]
    assert parts[0].content == "def f():\n" and parts[0].start_line == 10 and parts[0].end_line == 11
    assert all(len(p.content) <= 1500 for p in parts)
    lines = K.split_large(K.Chunk("\n".join("w" * 100 for _ in range(40)), 1, 40))
    assert {p.how for p in lines} == {"split_lines"} and "\n".join(p.content for p in lines) == "\n".join("w" * 100 for _ in range(40))


def test_handlers_and_imports(spark):
    def cut(text):
        head, body = text.split("\n\n", 1)
        return [(1, 2, head, tuple(head.split("\n"))), (4, 4, body)]

    def fails(text):
        raise RuntimeError

    text = "import a\nimport b\n\n" + "x = 1;" * 20
    rows = {r.file_path: r for r in K.chunk_files(make_files(spark, [("p", "s/a.py", text), ("p", "s/b.rb", text)]), {".py": cut, ".rb": fails}).where("chunk_index = 1 OR file_path = 's/b.rb'").collect()}
    assert rows["s/a.py"].content == "import a\nimport b\n\n" + "x = 1;" * 20 and rows["s/a.py"].how == "context_enriched"
    assert rows["s/b.rb"].content == text
    big = [K.Chunk("import z", 1, 1, imports=("import z",)), K.Chunk("y" * 1495, 2, 2)]
    assert K.with_imports(big) == big


def test_chunk_files(spark):
    token = fake_secrets()["github_token"]
    df = make_files(spark, [("p", "src/a.py", "x = 1\n" * 60 + f"k = '{token}'"), ("p", "README.md", f"k = '{token}'"), ("p", "e.py", "  \n "), ("p", "n.py", None)])
    rows = K.chunk_files(df).collect()
    assert {r.file_path for r in rows} == {"src/a.py", "README.md"}
    assert not any(token in r.content for r in rows if r.file_path == "src/a.py") and any(token in r.content for r in rows if r.file_path == "README.md")
    assert all(r.content_hash == hashlib.sha256(r.content.encode()).hexdigest() for r in rows)


@pytest.mark.parametrize(("n", "texts", "tokens", "batches"), [(2, 3, 100_000, 2), (600, 2, 10, 2), (10, 1, 50_000, 5)])
def test_packing_goldens(spark, n, texts, tokens, batches):
    df = spark.createDataFrame([("p", f"f{k:04d}", tokens, texts) for k in range(n)], "project_id string, file_path string, tokens long, texts long")
    assert B.pack_files(df).select("batch").distinct().count() == batches


def test_metric_goldens(spark):
    log = spark.createDataFrame([("create_project", 100.5, True), ("create_project", 150.2, True), ("create_project", 200.0, False), ("batch_insert", 500.0, True)], "operation string, ms double, ok boolean")
    by = {r.operation: r for r in M.operation_metrics(log).collect()}
    c = by["create_project"]
    assert (c.total, c.succeeded, c.failed, c.min_ms, c.max_ms) == (3, 2, 1, 100.5, 200.0) and c.avg_ms == pytest.approx(150.23, abs=0.1)
    errors = [(m,) for m in ("database is locked", "database is locked", "database is busy", "syntax error", "UNIQUE constraint failed")]
    stats = {r.error_class: r for r in M.error_stats(spark.createDataFrame(errors, "message string")).collect()}
    assert {k: r.errors for k, r in stats.items()} == {"DatabaseLockError": 2, "DatabaseBusyError": 1, "DatabaseSchemaError": 1, "DatabaseIntegrityError": 1}
    assert sum(r.errors for r in stats.values() if r.retryable) == 3
    assert M.top_messages(spark.createDataFrame(errors, "message string"), 1).first().message == "database is locked"


def test_vector_goldens(spark):
    meta = spark.createDataFrame([("p", "/t/1.py", "1751984561.6831303"), ("p", "/t/2.py", "1751984562.5"), ("p", "/t/1.py", "1751984563.0")], "project_id string, file_path string, file_mtime string")
    assert {r.file_path: r.mtime for r in V.latest_mtimes(meta).collect()} == {"/t/1.py": 1751984563.0, "/t/2.py": 1751984562.5}
    hits = spark.createDataFrame([(0, 1, 0.9, "src/utils.py", "h1"), (0, 2, 0.7, "src/helpers.py", "h2"), (0, 3, 0.85, "src/utils.py", "h1")], "query_id long, id long, similarity double, file_path string, content_hash string")
    assert [r.id for r in V.similar(hits, 0.8, 10).collect()] == [1]
    assert [r.id for r in V.similar(hits, 0.0, 10).collect()] == [1, 2]
    v = spark.createDataFrame([(i, [float(i % 7) - 3, 1.0, float(i % 5)]) for i in range(60)], "id long, vector array<double>")
    many = V.nearest_many(v, v.where("id < 9").select(F.col("id").alias("query_id"), "vector"), 4, block=4).collect()
    for q in range(9):
        vector = v.where(F.col("id") == q).first().vector
        assert [(r.id, pytest.approx(r.similarity)) for r in sorted(many, key=lambda r: r.rank) if r.query_id == q] == [(r.id, r.similarity) for r in V.nearest(v, vector, 4).collect()]


def test_upsert_delete_restore_purge(spark):
    f = make_files(spark, [("p", "a", "1"), ("p", "b", "2"), ("q", "a", "3")])
    marked = C.soft_delete(f, spark.createDataFrame([("p", "a"), ("p", "zz")], "project_id string, file_path string"), 1000)
    assert C.active(marked).count() == 2
    later = C.purge(marked, 1000 + 6 * C.RETENTION_MONTH)
    assert later.count() == 3 and C.purge(marked, 1001 + 6 * C.RETENTION_MONTH).count() == 2
    assert C.purge(marked, 1001 + 6 * C.RETENTION_MONTH, project_id="q").count() == 3
    new = make_files(spark, [("p", "a", "old"), ("p", "a", "new"), ("r", "c", "x")])
    merged = {(r.project_id, r.file_path): r for r in C.upsert(marked, new, ["project_id", "file_path"], "id").collect()}
    assert len(merged) == 4 and merged["p", "a"].description == "new" and merged["p", "a"].to_be_cleaned is None
    assert C.active(C.restore(marked, f)).count() == 3
    with pytest.raises(KeyError):
        C.set_vector_mode(spark.createDataFrame([("a", "a", [], False)], "id string, name string, aliases array<string>, vector_mode boolean"), "b", True)


def test_merkle_and_markdown(spark):
    f = spark.createDataFrame([(1, "p", "a.py", "x|y\nz", None, "h1"), (2, "p", "s/b.py", "B", None, "h2"), (3, "p", "s/t/c.py", "C", None, "h3")], FILES + ", file_hash string")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    nodes = {r.path: r for r in T.merkle(f).collect()}
    t = sha("c.py:h3")
    s = sha(f"b.py:h2|t:{t}")
    assert nodes["s/t"].hash == t and nodes["s"].hash == s and nodes[""].hash == sha(f"a.py:h1|s:{s}")
    assert nodes["s"].parent_path is None and nodes["s/t"].parent_path == "s" and len(nodes) == 6
    projects = spark.createDataFrame([("p", "my app", [], False)], "id string, name string, aliases array<string>, vector_mode boolean")
    overview = spark.createDataFrame([("p", "# Top\ntext")], "project_id string, overview string")
    text = T.project_markdown(projects, f, overview, "p").first().markdown
    assert text.startswith("# My App\n\n## Top\ntext\n\n## Root\n\n") and "| a.py | x\\|y z |" in text and text.index("## Root") < text.index("### s\n") < text.index("#### s/t")


def test_word_frequency(spark):
    f = make_files(spark, [("p", "a", "The module MODULE parse_x 2fast naïve return Zeta"), ("p", "b", "zeta module"), ("p", "c", None)])
    rows = [(r.term, r.frequency, r.total_terms, r.unique_terms) for r in S.word_frequency(f).collect()]
    assert rows == [("module", 3, 5, 2), ("zeta", 2, 5, 2)]
    assert S.word_frequency(f.limit(0)).count() == 0
    assert f.select(F.sum(token_estimate(F.col("description")))).first()[0] == sum(len(t) // 4 for t in ("The module MODULE parse_x 2fast naïve return Zeta", "zeta module"))


def test_stop_words_and_several_terms(spark, tmp_path):
    (tmp_path / "stop.txt").write_text("Module\n\n  zeta \n")
    assert S.stop_words_file(spark, str(tmp_path / "stop.txt")) == ("module", "zeta")
    f = make_files(spark, [("p", "a", "module zeta omega"), ("p", "b", "omega omega"), ("p", "c", "zeta")])
    assert [r.term for r in S.word_frequency(f, stop=S.stop_words_file(spark, str(tmp_path / "stop.txt"))).collect()] == ["omega"]
    assert [(r.file_path, r.term_position) for r in S.multi_term_search(f, ["zeta", "omega", "none"]).collect()] == [("c", 0), ("a", 0), ("b", 1)]
    assert S.multi_term_search(f, []).count() == 0


def test_vectors_that_take_no_part(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0]), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, [1.0, 1.0]), (8, [1.0, 0.0])]
    v = spark.createDataFrame(rows, "id long, vector array<double>")
    got = V.nearest_many(v, v.select(F.col("id").alias("query_id"), "vector"), 2).collect()
    assert {(r.query_id, r.rank): r.id for r in got} == {(1, 1): 1, (1, 2): 8, (7, 1): 7, (7, 2): 1, (8, 1): 1, (8, 2): 8}


def test_objects_in_noisy_text():
    assert B.first_object('x {y} {"a": {"b": 1}} {"c": 2}') == {"a": {"b": 1}}
    assert B.first_object("{" * 20_000 + '{"a": 1}') == {"a": 1} and B.first_object("}{") is None and B.first_object("") is None


def test_walking_a_folder(spark, tmp_path):
    for p in ("a/x.py", "a/b/y.py", "node_modules/deep/z.js", "m.py"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("code")
    paths = lambda **o: sorted(r.file_path for r in walk_files(spark, str(tmp_path), **o).collect())
    assert paths() == ["a/b/y.py", "a/x.py", "m.py", "node_modules/deep/z.js"]
    assert paths(pruned=("node_modules/",)) == ["a/b/y.py", "a/x.py", "m.py"] and paths(most=2) == ["a/b/y.py", "a/x.py"]
    rows = spark.createDataFrame([(3, b"abc", 5), (3, None, 5), (3, None, None), (1 << 21, None, 5)], "length long, content binary, modified long")
    hashes = [r.h for r in rows.select(L.file_hash(F.col("length"), F.col("content"), F.col("modified")).alias("h")).collect()]
    assert hashes == [hashlib.sha256(b"abc").hexdigest(), "error", "deleted", hashlib.sha256(b"2097152:5").hexdigest()]


def test_literals_never_hide_a_match(spark):
    """Texts of fragments of secrets, with letters that only case tells apart: whoever has a match is let through, and
    nothing else is found with literals than without."""
    rng = random.Random(4)
    bits = [*fake_secrets().values(), "paſſword = ", "pwd:", "toKen=", "ſecret : x1", "AKIA", "akıa" + "A" * 16, "://", "http://a:b@c", "redİs://x", "k" * 31, "K" * 45, "key", " ", "\n", "zz", "config ", "-----BEGIN RSA PRIVATE KEY-----a-----END RSA PRIVATE KEY-----", "sk-", "PA-" + "b" * 32]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 4))) for _ in range(1500)] + bits
    quick, whole = K.Redactor(), K.Redactor()
    whole.literals = {}
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string").select("k", "t", K.may_hold_secret(K.case_folded(F.col("t"))).alias("may")).collect()
    assert sum(not r.may for r in rows) > 100
    for r in rows:
        raw = [m for name, _, _, _, p in whole.patterns for m in p.finditer(r.t)]
        assert r.may or not raw, r.t
        assert quick.find(r.t, "a.py") == whole.find(r.t, "a.py"), r.t


def test_secret_patterns_compile():
    assert all(re.compile(p[4]) for p in K.PATTERNS)


def test_places_in_order_over_ranges(spark):
    """One key holds most rows, and they are numbered over several tasks."""
    rng = random.Random(9)
    rows = [("hot" if k % 10 else f"k{k % 7}" if k % 20 else None, k * 7919 % 5003, rng.randrange(9)) for k in range(3000)]
    df = spark.createDataFrame(rows, "key string, at long, size long").repartition(6)
    with_places = placed(df, ["key"], ["at"], "size")
    got = {(r.key, r.at): (r.place, r.n, r.upto_size) for r in with_places.collect()}
    for key in {r[0] for r in rows}:
        own, upto = sorted((at, size) for k, at, size in rows if k == key), 0
        for place, (at, size) in enumerate(own, 1):
            upto += size
            assert got[key, at] == (place, len(own), upto)
    assert with_places.columns == ["key", "at", "size", "place", "n", "upto_size"] and len(got) == 3000


def test_embedding_counts_words(spark):
    texts = ["a b a", "", None, "Über über ÜBER x_1", "one two three " * 500]
    got = V.embed(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, content string"), 32).orderBy("k").collect()
    slots = lambda t: [r.s for r in spark.createDataFrame([(w,) for w in re.findall(r"\w+", (t or "").lower())] or [("",)], "w string").selectExpr("cast(pmod(xxhash64(w), 32) as int) s", "w").where("w <> ''").collect()]
    for r, t in zip(got, texts, strict=True):
        counts = [slots(t).count(s) for s in range(32)]
        norm = sum(c * c for c in counts) ** 0.5 or 1
        assert r.vector == pytest.approx([c / norm for c in counts])


def test_upsert_of_vectors_takes_the_last_of_an_id(spark):
    stored = spark.createDataFrame([(1, "old", 1.0), (2, "old", 1.0)], "id long, content string, file_mtime double")
    new = spark.createDataFrame([(1, "b", 3.0), (1, "a", 5.0), (3, "c", 1.0), (3, "d", 1.0)], "id long, content string, file_mtime double")
    assert sorted(map(tuple, V.upsert_vectors(stored, new, "file_mtime", "content").collect())) == [(1, "a", 5.0), (2, "old", 1.0), (3, "d", 1.0)]
    assert sorted(map(tuple, V.upsert_vectors(stored, new).collect())) == [(1, "b", 3.0), (2, "old", 1.0), (3, "d", 1.0)]


def plain_sizes(chunks, small=50, most=1500):
    """The size rules for chunks (content, first line, last line), written a second time: runs of small neighbours are one."""
    runs = []
    for content, a, b in chunks:
        last = runs[-1] if runs else None
        if len(content) < small and last and last[0] and len(last[1][-1][0]) + len(content) + 2 <= most:
            last[1].append((content, a, b))
        else:
            runs.append((len(content) < small, [(content, a, b)]))
    return [("\n\n".join(c for c, _, _ in own), min(a for _, a, _ in own), max(b for _, _, b in own), len(own)) for _, own in runs]


def plain_split(content, most=1500):
    """Texts of the parts of a large chunk: cut after ends of blocks, long pieces at white space; without any, by lines."""
    if len(content) <= most:
        return [content]
    lines = content.split("\n")
    ends = [k for k, x in enumerate(lines) if not x.strip() or x.strip().startswith(("def ", "class ", "function ", "const ", "let ", "var ")) or x.strip().endswith(("{", "}", ";"))]
    if not ends:
        out, run = [], []
        for line in lines:
            if run and sum(len(x) + 1 for x in run) + len(line) + 1 > most:
                out.append("\n".join(run))
                run = []
            run.append(line)
        return [*out, "\n".join(run)]
    pieces, at = [], 0
    for k in ends:
        pieces.append("\n".join(lines[at : k + 1]) + ("\n" if k + 1 < len(lines) else ""))
        at = k + 1
    tail = "\n".join(lines[at:])
    out = []
    for piece in pieces:
        if len(piece) <= most:
            out.append(piece)
            continue
        while len(piece) > most:
            cut = max(piece.rfind(c, 1, most + 1) for c in " \n\t")
            cut = cut if cut > 0 else most
            out.append(piece[:cut])
            piece = piece[cut:]
        out.append(piece)
    return [x for x in [*out, tail] if x.strip()] or [content]


def test_size_rules_against_a_second_writing():
    rng = random.Random(12)
    words = ["x", "word " * 20, "def f():", "class A {", "}", "", "a = 1;", "y" * 700, "long " * 400, "let z", "\t", "tail"]
    for _ in range(400):
        chunks, line = [], 1
        for _ in range(rng.randrange(1, 9)):
            content = "\n".join(rng.choice(words) for _ in range(rng.randrange(1, 6)))[: rng.choice([30, 49, 50, 1500, 9000])] or "q"
            chunks.append(K.Chunk(content, line, line + content.count("\n")))
            line += content.count("\n") + 1
        got = K.join_small(chunks)
        want = plain_sizes([(c.content, c.start_line, c.end_line) for c in chunks])
        assert [(c.content, c.start_line, c.end_line) for c in got] == [w[:3] for w in want]
        assert [c.name for c in got] == [f"combined_{n}_chunks" if n > 1 else None for *_, n in want]
        for c in got:
            assert [p.content for p in K.split_large(c)] == plain_split(c.content), c.content
