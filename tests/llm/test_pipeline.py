import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from quarry.llm import quality
from tests.llm.test_mixing import brute_targets
from tests.llm.test_simhash import jaccard


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """What goes into each stage, and what the last one returns."""
    folder = tmp_path_factory.mktemp("stages")
    docs = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs[-1], sf_dir).write.parquet(f"{folder}/{k}")
        docs.append(spark.read.parquet(f"{folder}/{k}"))
    return docs


def test_the_stages_and_their_columns(stages):
    assert [name for name, _ in P.STAGES] == ["quality", "exact_dedup", "near_dedup", "mix", "encode"]
    for table in stages[:-1]:
        assert table.columns == stages[0].columns
    assert P.ORACLE_SQL is None


def test_quality_keeps_what_the_model_accepts(spark, sf_dir, stages):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    want = {r.doc_id for r in quality.score_quality(stages[0], labels).collect() if r.score >= 0.3}
    assert {r.doc_id for r in stages[1].collect()} == want
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    assert len(good & want) >= 0.98 * len(good)


def test_copies_go(stages):
    texts = defaultdict(list)
    for r in stages[1].collect():
        texts[r.text.encode().lower()].append(r.doc_id)
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(max(ids) for ids in texts.values())


def test_near_copies_go(stages):
    rows = sorted((r.doc_id, r.text) for r in stages[2].collect())
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            if jaccard(a, b) >= 0.8:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted({root(i) for i, _ in rows})


def test_the_mix_meets_its_targets(stages):
    rows = [(r.doc_id, r.text, r.source) for r in stages[3].collect()]
    size, target = brute_targets(rows)
    taken, copies = Counter(), Counter()
    for r in stages[4].collect():
        taken[r.source] += len(r.text.encode().split())
        copies[r.doc_id] += 1
    assert max(copies.values()) <= 2
    longest = {s: max(len(t.encode().split()) for _, t, x in rows if x == s) for s in target}
    assert all(abs(taken[s] - target[s]) <= longest[s] / 2 + 1 for s in target)


def test_encoding_and_the_whole_run(spark, sf_dir, stages):
    theirs = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in stages[4].collect():
        ids = theirs.encode(r.text, add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(theirs.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, stages[5].collect())) == sorted(want)
    assert sorted(map(tuple, P.run(spark, sf_dir).collect())) == sorted(want)


def test_an_empty_table(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.count() == 0


ODD = "doc_id long, text string, lang string, source string, n_chars long, `meta.url` string, row string, doc string, size long, node long, draw string, body binary, u double"


def odd_rows():
    long = " ".join(f"word{k % 977}" for k in range(200_000))
    texts = [None, "", "  \n", "A tie", "a TIE", long, long + " end", "plain words that stay as they are, for once and for all", "\x00 \ud7ff é"]
    rows = [(k, t, None if k % 3 else "en", None if k % 2 else "s", None, "u", "r", None, k, None, "d", b"b", None) for k, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], (None, "A tie", None, None, None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None, None, None), (7, "another text of the same number", "de", "s", 3, "", "", "", 0, 0, "", b"", 0.0)]


def test_odd_rows_through_every_stage(spark, sf_dir, tmp_path):
    """Nulls, empty and very long texts, repeated rows, one number for two texts, and columns with odd and clashing names."""
    spark.createDataFrame(odd_rows(), ODD).write.parquet(f"{tmp_path}/in")
    docs = spark.read.parquet(f"{tmp_path}/in")
    before, out = docs.collect(), {}
    for name, stage in P.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        table = spark.read.parquet(f"{tmp_path}/{name}")
        out[name] = table.collect()
        if name != "encode":
            assert table.columns == docs.columns
            assert not Counter(out[name]) - Counter(before) or name == "mix"
    norm = lambda t: (t or "").encode().lower()
    assert Counter(norm(r.text) for r in out["exact_dedup"]) == Counter({norm(r.text) for r in before})
    assert Counter(b" ".join(norm(r.text).split())[:40] for r in out["near_dedup"]) == Counter({b" ".join(norm(r.text).split())[:40] for r in before})
    assert next(r.doc_id for r in out["near_dedup"] if norm(r.text) == b"a tie") == 3
    assert max(Counter(out["mix"]).values()) <= 2 * max(Counter(before).values()) and not Counter(set(out["mix"])) - Counter(set(before))
    assert sorted(map(str, (r.doc_id for r in out["encode"]))) == sorted(map(str, (r.doc_id for r in before)))
    good = Counter(out["quality"])
    assert all(n == Counter(before)[r] for r, n in good.items())


def test_operators_ignore_other_columns(spark, sf_dir):
    """Each query's operator over the odd rows: a row for each, the same with and without the odd columns."""
    from quarry.llm import align, bpe, exact_dedup, kneser_ney, language, licenses, mixing, pii, ranked, simhash
    from quarry.llm.queries import PIECES

    docs = spark.createDataFrame(odd_rows(), ODD)
    plain = docs.select("doc_id", "text", "lang", "source")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumn("meta.x", F.lit(1))
    runs = {
        "radix": exact_dedup.radix_groups, "mix": mixing.pareto_mix, "pii": pii.find_private, "simhash": simhash.near_duplicates, "quality": lambda d: quality.score_quality(d, labels),
        "bpe": lambda d: bpe.encode_digests(d, P.VOCABULARY), "licenses": licenses.scan_licenses, "language": language.identify, "ngrams": kneser_ney.score_documents,
        "links": lambda d: align.link_tokens(d, P.VOCABULARY, PIECES),
    }
    items = spark.createDataFrame([(1, "a TIE of words"), (2, "word5 word7")], "item_id long, text string")
    assert sorted(map(str, ranked.ranked_search(docs, items).collect())) == sorted(map(str, ranked.ranked_search(plain, items).collect()))
    for name, run in runs.items():
        got, want = run(docs).collect(), run(plain).collect()
        assert len(got) == docs.count(), name
        if name not in ("radix", "mix"):  # of equal rows one stays or is taken, by its place
            assert sorted(map(str, got)) == sorted(map(str, want)), name
