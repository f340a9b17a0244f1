import html
import os.path

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import batches as B
from quarry.operators.tree import IGNORED_PATTERNS, is_ignored


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'long' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("query", "match"), [
    ("grpc proto", '"grpc" AND "proto"'), ("error AND handling", '"error" AND "AND" AND "handling"'), ('config "file system"', '"config" AND "file system"'),
    ("  grpc    proto  ", '"grpc" AND "proto"'), ('test "" another', '"test" AND "" AND "another"'), ('test "unclosed quote', '"test" AND ""unclosed" AND "quote"'),
    ("", ""), ("   ", ""), (None, ""),
])
def test_query_goldens(spark, query, match):
    assert spark.createDataFrame([(query,)], "q string").select(X.preprocess_query(F.col("q"))).first()[0] == match


@pytest.mark.parametrize("path", ["a.py", "x/y/b.TS", ".gitignore", "a/.env", "n", "a.b/c", "x/archive.tar.gz", "d/"])
def test_paths(spark, path):
    assert one(spark, X.suffix(F.col("p")), p=path) == os.path.splitext(path)[1].lower()
    assert one(spark, X.base_name(F.col("p")), p=path) == os.path.basename(path)
    assert one(spark, X.parent(F.col("p")), p=path) == os.path.dirname(path)


@pytest.mark.parametrize(("path", "ignored"), [
    ("src/main.py", False), ("node_modules/lib.js", True), ("a/__pycache__/m.cpython-39.pyc", True), ("image.PNG", True), ("README.md", False), ("mybuild/x.py", False),
    ("x/build/y.py", True), ("x/app.log", True), ("yarn.lock", True), ("docs/_build/i.py", True), ("env.py", False), ("a~", True),
])
def test_ignored(spark, path, ignored):
    assert one(spark, is_ignored(F.col("p")), p=path) is ignored
    assert len(IGNORED_PATTERNS) == 52


def test_globs_cross_folders(spark):
    assert one(spark, X.glob_match(F.col("p"), ["a/*"]), p="a/b/c.py")
    assert not one(spark, X.glob_match(F.col("p"), ["a/*"]), p="b/a/c.py")
    assert one(spark, X.glob_match(F.col("p"), ["*.[pq]y?"]), p="x/y.pyc")


def test_marker_has_the_length_of_what_it_covers(spark):
    for n in (1, 5, 16, 17, 40):
        assert one(spark, X.redaction_marker("api_key", F.col("m")), m="k" * n) == "[REDACTED:API_KEY]"[:n].ljust(n, "X")


def test_entities_without_a_semicolon_stay_if_told_to(spark):
    for t, want in (("a&amp</title> &amp;", "a&amp</title> &"), ("&lt &ampx; &unknown; &#65;&#x42; &am &", "&lt &ampx; &unknown; AB &am &"), ("&amp;lt; &quot;&copy;", '&lt; "©')):
        assert one(spark, X.unescape_html(F.col("t"), closed=True), t=t) == want


def test_small_functions(spark):
    assert one(spark, X.namespace(F.col("n")), n="My App/é-1_x") == "mcp_code_my_app_é-1_x"
    for t in ("&#65;&#x42; &#8364; &#0; &notin; &lt &ampx &unknown; &#99999999;", "plain", ""):
        assert one(spark, X.unescape_html(F.col("t")), t=t) == html.unescape(t)
    assert one(spark, X.unescape_html(F.col("t")), t="a &amp;lt; &quot;b&quot; &copy;") == html.unescape("a &amp;lt; &quot;b&quot; &copy;")
    assert one(spark, X.demote_headers(F.col("t")), t="# a\n## b\nx # c") == "## a\n### b\nx # c"
    assert one(spark, X.demote_headers(F.col("t")), t="## a") == "## a"
    assert one(spark, X.ellipsis(F.col("t"), 3), t="abcd") == "abc..."
    assert one(spark, X.client_ip(F.col("f"), F.col("r"), F.col("p")), f=" 1.1.1.1 , 2.2.2.2", r="3", p="4") == "1.1.1.1"
    assert one(spark, X.client_ip(F.col("f"), F.col("r"), F.col("p")), f="", r=" 3", p="4") == "3"
    assert one(spark, X.backoff(F.col("b"), F.col("n")), b=0.5, n=3) == 2.0
    assert one(spark, X.scrub(F.col("t"), 4), t="a\x00b\tcdef") == "ab\tc"
    assert one(spark, X.provider_error(F.col("s"), F.col("m")), s=429, m="Slow down") == "rate_limit"
    assert one(spark, X.line_section(F.col("t"), 2, 9), t="a\nb\nc") == "b\nc"
    assert one(spark, X.line_section(F.col("t"), 4, 9), t="a\nb\nc") is None
    assert one(spark, X.diff_chunk_size(F.col("t"), F.col("n")), t=0, n=0) == 10
    assert one(spark, X.diff_chunk_size(F.col("t"), F.col("n")), t=700_000, n=10) == 5
    assert one(spark, X.diff_chunk_size(F.col("t"), F.col("n")), t=70_000, n=10) == 10


def test_error_rules(spark):
    cases = [("database is locked", "DatabaseLockError", "read", True), ("attempt to write a readonly database", "DatabaseLockError", "write", True), ("database is busy", "DatabaseBusyError", "connection", True),
             ("near x: syntax error", "DatabaseSchemaError", "", False), ("UNIQUE constraint failed: a.b", "DatabaseIntegrityError", "unique", False), ("odd", "DatabaseError", "", False)]
    for message, kind, sub, again in cases:
        m = F.col("m")
        row = spark.createDataFrame([(message,)], "m string").select(X.error_class(m), X.error_subtype(m), X.retryable(m)).first()
        assert tuple(row) == (kind, sub, again)


def test_json(spark):
    ok = one(spark, F.to_json(B.parse_json(F.col("t"))), t='{url: https://x.org/a, "p": /a/b, n: word, l: true,}')
    assert '"url":"https://x.org/a"' in ok and '"p":"/a/b"' in ok and '"n":"word"' in ok
    assert B.first_object('x {bad} y {"a": {"b": 1}} z') == {"a": {"b": 1}}
    assert B.first_object("none { here") is None
