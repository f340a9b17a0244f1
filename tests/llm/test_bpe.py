import hashlib
import random

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarry.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
OURS, THEIRS = bpe.Bpe(PATH), Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(blacklist_categories=["Cs"]), st.sampled_from("aabeht  \n\t'sé<|>endoftext")), max_size=200))
def test_same_ids_and_round_trip(text):
    ids = OURS.encode(text)
    assert ids == THEIRS.encode(text, add_special_tokens=False).ids
    assert OURS.decode(ids) == THEIRS.decode(ids, skip_special_tokens=False) == text


def test_long_and_repeated_pieces():
    rng = random.Random(2)
    for text in ("a" * 5001, "ab" * 3000, "".join(rng.choice("aeinrst") for _ in range(20_000)), " " * 999 + "x", "<|endoftext|>" * 3 + "a <|endoftext|>"):
        assert OURS.encode(text) == THEIRS.encode(text, add_special_tokens=False).ids


def test_rank_that_comes_up_late():
    """A merge can bring up a pair of lower rank: it goes before other places of the merge."""
    odd = bpe.Bpe(PATH)
    a, b, c, d = 1000, 1001, 1002, 1003
    odd.byte_ids = list(odd.byte_ids)
    for ch, i in zip("abcd", (a, b, c, d), strict=True):
        odd.byte_ids[ord(ch)] = i
    bc, abc, abcd, dd = 2000, 2001, 2002, 2003
    odd.merges = [(b, c, bc), (abc, d, abcd), (d, a, dd), (a, bc, abc)]
    odd.prepare()
    assert odd.late == {3}
    assert odd.encode_pieces(["abcdabc"]) == [[abc, dd, bc]]
    assert odd.encode_pieces(["abcd", "", "abc", "abcabcd"]) == [[abcd], [], [abc], [abc, abcd]]


def test_digests_over_a_table(spark, sf_dir):
    rows = [(1, "Hello <|endoftext|> wörld", "x"), (2, None, "x"), (3, "", "x"), (None, "tie tie", "x"), (None, "tie tie", "x"), (7, "la " * 30_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe.encode_digests(df, PATH).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t, _ in rows:
        ids = THEIRS.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(THEIRS.decode(ids, skip_special_tokens=False))))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert bpe.encode_digests(df.limit(0), PATH).count() == 0
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in bpe.encode_digests(docs, PATH).collect()}
    for r in docs.collect():
        ids = THEIRS.encode(r.text, add_special_tokens=False).ids
        assert got[r.doc_id] == (len(ids), sha(",".join(map(str, ids))))
    assert {r.doc_id: len(r.ids) for r in bpe.encode_ids(docs, PATH).collect()} == {k: v[0] for k, v in got.items()}
