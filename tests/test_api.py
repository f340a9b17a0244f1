import pytest

from quarry.api import Engine, ToolError
from quarry.operators import vectors as V
from quarry.sources.listing import Settings, list_files, read_texts

OWN = {"projectName": "Demo", "folderPath": "/w/demo"}


def test_workflow(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "db"), clock=lambda: 1_700_000_000)
    assert engine.call("get_file_description", **OWN, filePath="a.py")["exists"] is False
    for path, text in (("src/auth.py", "Authentication and authorization module"), ("src/db.py", "database pool"), ("main.py", "Entry point. Starts the pool.")):
        assert engine.call("update_file_description", **OWN, filePath=path, description=text)["success"]
    engine.call("update_file_description", **OWN, filePath="src/db.py", description="def connect(pool):\n    return pool.take()")
    got = engine.call("get_file_description", **OWN, filePath="src/db.py")
    assert got["description"].startswith("def connect") and got["version"] == 1
    assert [r["filePath"] for r in engine.call("search_descriptions", **OWN, query="authentication")["results"]] == ["src/auth.py"]
    size = engine.call("check_codebase_size", **OWN)
    assert size["recommendation"] == "use_overview" and not size["isLarge"] and (size["totalFiles"], size["cleanedUpCount"]) == (3, 0)
    assert engine.call("check_codebase_size", **OWN, tokenLimit=1)["recommendation"] == "use_search"
    missing = engine.call("find_missing_descriptions", **OWN, listing=["main.py", "new.py", "node_modules/x.js", "b.py"], limit=1)
    assert missing == {"missingFiles": ["b.py"], "totalMissing": 2, "returnedCount": 1, "existingDescriptions": 1, "totalTrackable": 3}
    tree = engine.call("get_all_descriptions", **OWN)
    assert tree["totalFiles"] == 3 and [f["path"] for f in tree["structure"]["folders"]] == ["src"]
    assert engine.call("get_codebase_overview", **OWN) == {"hasOverview": False}
    engine.call("update_codebase_overview", **OWN, overview="One. The pool is here! Two? Three. Four")
    assert engine.call("get_codebase_overview", **OWN)["totalFiles"] == 3
    found = engine.call("search_codebase_overview", **OWN, searchWord="POOL")
    assert found["totalMatches"] == 1 and found["matches"][0]["matchContext"] == "One. The pool is here. Two. Three."
    words = engine.call("get_word_frequency", **OWN)
    assert words["topTerms"][0] == {"term": "pool", "frequency": 3}
    assert engine.call("enabled_vector_mode", **OWN, enabled=True)["vectorMode"]
    assert engine.index_vectors(**OWN) == 3
    near = engine.call("find_similar_code", **OWN, file_path="src/db.py", line_start=1, line_end=2)["results"]
    assert near[0]["filePath"] == "src/db.py" and near[0]["similarity"] == pytest.approx(1)
    assert engine.call("check_database_health") == {"health": [], "operations": [], "errors": []}
    other = engine.call("get_file_description", projectName="DEMO", folderPath="/else", filePath="main.py")
    assert other["exists"] and engine.table("projects").count() == 1
    assert engine.table("projects").first().aliases == ["/w/demo", "/else"]


def test_clean_up_and_retention(spark, tmp_path):
    now = [1_700_000_000]
    home = tmp_path / "w"
    home.mkdir()
    (home / "kept.py").write_text("x")
    own = {"projectName": "Demo", "folderPath": str(home)}
    engine = Engine(spark, str(tmp_path / "db"), clock=lambda: now[0])
    for path in ("kept.py", "gone.py"):
        engine.call("update_file_description", **own, filePath=path, description=f"about {path} &amp; more")
    assert engine.call("get_file_description", **own, filePath="gone.py")["description"] == "about gone.py & more"
    assert engine.call("check_codebase_size", **own)["cleanedUpCount"] == 1
    assert engine.call("check_codebase_size", **own)["totalFiles"] == 1
    assert [r["filePath"] for r in engine.call("search_descriptions", **own, query="about")["results"]] == ["kept.py"]
    assert engine.table("files").count() == engine.table("search").count() == 2
    now[0] += 7 * 30 * 86_400
    assert engine.call("check_codebase_size", **own)["cleanedUpCount"] == 1
    assert engine.table("files").count() == engine.table("search").count() == 1
    assert engine.call("find_missing_descriptions", **own)["missingFiles"] == []


def test_rows_are_put_beside_a_version_and_merged(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "db"), most_parts=3, clock=lambda: 1_700_000_000)
    seen = []
    for k in range(7):
        engine.call("update_file_description", **OWN, filePath=f"f{k % 3}.py", description=f"text {k}")
        seen.append(len(engine._parts("files")))
    assert max(seen) < 3 and 0 in seen
    assert sorted(r.description for r in engine.table("files").collect()) == ["text 4", "text 5", "text 6"]
    assert engine.table("search").count() == 3
    assert engine.call("search_descriptions", **OWN, query="6")["results"][0]["filePath"] == "f0.py"


def test_indexing_takes_changed_files_alone(spark, tmp_path):
    now, embedded = [1_700_000_000], []

    def embed(chunks):
        embedded.append(sorted({r.file_path for r in chunks.collect()}))
        return V.embed(chunks, 16)

    engine = Engine(spark, str(tmp_path / "db"), clock=lambda: now[0], embed=embed, handlers={".sql": lambda text: [(1, 1, part) for part in text.split(";")]})
    for path in ("a.py", "b.py"):
        engine.call("update_file_description", **OWN, filePath=path, description="code " * 30)
    engine.call("update_file_description", **OWN, filePath="q.sql", description="SELECT " + "a " * 40 + ";SELECT " + "b " * 40)
    assert engine.index_vectors(**OWN) == 4
    now[0] += 10
    engine.call("update_file_description", **OWN, filePath="b.py", description="other " * 30)
    assert engine.index_vectors(**OWN) == 4 and embedded == [["a.py", "b.py", "q.sql"], ["b.py"]]
    meta = engine.table("index_meta").first()
    assert (meta.sync_status, meta.total_files, meta.indexed_chunks, meta.last_sync) == ("completed", 3, 4, now[0])


def test_calls_are_checked(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    assert len(engine.tools) == 13
    for tool, arguments in (("nothing", {}), ("get_word_frequency", {"projectName": "x"}), ("get_word_frequency", {**OWN, "odd": 1}), ("find_similar_code", OWN)):
        with pytest.raises(ToolError):
            engine.call(tool, **arguments)


def test_listing(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.py").write_text("code")
    (tmp_path / "y.txt").write_bytes(b"ok \xff")
    (tmp_path / "z.txt").write_text("  ")
    assert sorted((r.file_path, r.size) for r in list_files(spark, str(tmp_path)).collect()) == [("a/x.py", 4), ("y.txt", 4), ("z.txt", 2)]
    assert sorted(r.file_path for r in read_texts(spark, str(tmp_path)).collect()) == ["a/x.py", "y.txt"]
    settings = Settings.load("max_search_results: 7\n# x: 1\nbatch_size: 3", {"QUARRY_BATCH_SIZE": "9"})
    assert (settings.max_search_results, settings.batch_size, settings.token_limit) == (7, 9, 32_000)


def test_indexing_goes_on_where_it_stopped(spark, tmp_path):
    """A run that fails in its second job: the batches of the first aren't done again, and the vectors are those of a run
    without a failure."""
    own = {"projectName": "Demo", "folderPath": "/w/demo"}
    seen = []

    def embed(chunks):
        seen.append({r.file_path for r in chunks.select("file_path").distinct().collect()})
        if len(seen) == fail_at:
            raise RuntimeError("lost")
        return V.embed(chunks, 8)

    def engine(name):
        e = Engine(spark, str(tmp_path / name), clock=lambda: 1_700_000_000, embed=embed, batch_files=3, in_flight=2)
        rows = spark.createDataFrame([(k, f"src/f{k}.py", f"def f{k}():\n    return {k}  # number {k} of the files", "h", 1_700_000_000 + k) for k in range(20)], "id long, file_path string, description string, file_hash string, last_modified long")
        e._put_files(rows.selectExpr("id", f"'{e._project('Demo', '/w/demo')}' project_id", "file_path", "description", "file_hash", "last_modified", "1L version", "cast(null as long) to_be_cleaned"))
        return e

    vectors = lambda e: sorted((r.id, r.file_path, r.content_hash, r.file_mtime, tuple(r.vector)) for r in e.table("vectors").collect())
    fail_at = 0
    whole = engine("whole")
    assert whole.index_vectors(**own) == 20
    jobs, fail_at = len(seen), len(seen) + 2
    broken = engine("broken")
    with pytest.raises(RuntimeError):
        broken.index_vectors(**own)
    meta = broken.table("index_meta").first()
    assert meta.sync_status == "failed" and meta.error_message == "lost" and broken.table("vectors").count() == 0
    ledger = {r.batch: r.status for r in broken.table("index_batches").where("batch >= 0").collect()}
    assert sorted(ledger.values()).count("completed") == 2 and sorted(ledger.values()).count("failed") == 2
    fail_at = 0
    again = Engine(spark, str(tmp_path / "broken"), clock=lambda: 1_700_000_000, embed=embed, batch_files=3, in_flight=2)
    broken.call("enabled_vector_mode", **own, enabled=True)
    assert list(again.run_pending().values()) == [20]
    assert vectors(again) == vectors(whole) and not (seen[jobs] & set().union(*seen[jobs + 2 :]))
    attempts = {r.batch: r.attempts for r in again.table("index_batches").where("batch >= 0").collect()}
    assert sorted(attempts.values()) == [1] * (len(attempts) - 2) + [2, 2]
    assert set(r.status for r in again.table("index_batches").collect()) == {"completed"} and again.run_pending() == {}
    done = len(seen)
    again.call("update_file_description", **own, filePath="src/f3.py", description="def g():\n    return 'changed since then'")
    again.clock = lambda: 1_800_000_000
    again.call("update_file_description", **own, filePath="src/f4.py", description="def g():\n    return 'changed since'")
    again.pause(**own)
    assert list(again.run_pending().values()) == [20] and set().union(*seen[done:]) <= {"src/f3.py", "src/f4.py"}
