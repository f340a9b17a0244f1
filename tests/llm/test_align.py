import bisect
import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarry.llm import align
from quarry.llm.bpe import SHOWN

PATHS = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
A, B = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
A.encode_special_tokens = True
BYTE = {chr(b): b for b in SHOWN}
BYTE |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if chr(b) not in BYTE)}


def tokens(text):
    """Both tokenizers' (id, bytes) of the whole text, or nothing."""
    if not text:
        return None
    a = [(i, bytes(BYTE[c] for c in A.id_to_token(i))) for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode()) for i in B.encode(text)]
    raw = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == b"".join(x for _, x in b) == raw else None


def groups(a, b):
    def ends(ts):
        e = 0
        return [e := e + len(x) for _, x in ts]

    cuts = sorted({*ends(a)} & {*ends(b)})
    sides = defaultdict(list), defaultdict(list)
    for side, own in zip(sides, (a, b), strict=True):
        for (i, _), e in zip(own, ends(own), strict=True):
            side[bisect.bisect_left(cuts, e)].append(i)
    return [(sides[0][k], sides[1][k]) for k in range(len(cuts))]


def brute(rows):
    parts = [tokens(t) for _, t in rows]
    found = [groups(*p) if p else None for p in parts]
    links = [[(x, y) for p, q in g for x in p for y in q] if g else [] for g in found]
    count = Counter(pair for own in links for pair in set(own))
    best = Counter()
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for (i, _), p, g, own in zip(rows, parts, found, links, strict=True):
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g) if g else ""
        out.append((i, len(p[0]) if p else 0, len(p[1]) if p else 0, len(g or ()), len(own), sum(count[x] == best[x[0]] for x in own), sum(count[x] for x in own), hashlib.sha256(shown.encode()).hexdigest() if g else ""))
    return sorted(out, key=str)


PAIR = align.Pair(*PATHS)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(blacklist_categories=["Cs"]), st.sampled_from("aabeht   \n\t　 ▁'sé<|>endoftext<0x0A>\x00\x1f")), max_size=60))
def test_words_give_the_tokens_of_the_whole(text):
    words = align.WORD.findall(" " + text) if text else []
    assert "".join(words) == (" " + text if text else "")
    a, a_n, b, b_n = PAIR.encode(words) if words else ([], [], [], [])
    want = tokens(text)
    if want is None:
        assert not text or 0 in a_n
    else:
        assert list(a) == [i for i, _ in want[0]] and list(b) == [i for i, _ in want[1]]
        assert sum(a_n) == len(a) and sum(b_n) == len(b)


def test_large_groups_count_as_small_ones_do():
    """Groups without a common end inside, by a block made by hand: pairs of ids with their times, however they are found."""
    block = align.Block.__new__(align.Block)
    block.word, block.of_a, block.of_b = np.array([0, 0, 1]), np.array([3, 1, 2]), np.array([2, 1, 2])
    block.a, block.b, block.groups = np.array([5, 6, 5, 7, 8, 9]), np.array([1, 1, 2, 3, 3]), np.array([2, 1])
    seen = []
    for most in (100, 2, 0):
        times = Counter()
        for w, p, n in zip(*block.links(most), strict=True):
            times[w, p >> 32, p & 0xFFFFFFFF] += n
        seen.append(times)
    assert seen[0] == seen[1] == seen[2] == Counter({(0, 5, 1): 4, (0, 6, 1): 2, (0, 7, 2): 1, (1, 8, 3): 2, (1, 9, 3): 2})


ROWS = [(0, "A tie, a TIE of ties"), (1, None), (2, ""), (3, " "), (4, "  two  spaces \n and\t tabs  "), (5, "wörld naïve 数学は 🎉🎉 <|endoftext|> <s> </s> <0x0A>"), (6, "a▁sign"), (None, "A tie, a TIE of ties"), (None, None), (0, "another text"), (0, "another text"), (9, "la " * 20_000 + "x" * 3000), (10, "aaaaaaaaaaaaaaa" * 40 + "=" * 999)]


def test_against_brute_force(spark, sf_dir):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in ROWS], "doc_id long, text string, block string, `a.word` int, words int")
    want = brute(ROWS)
    for chars in (1, 50, 4_000_000):
        assert sorted((tuple(r) for r in align.link_tokens(df, *PATHS, chars=chars).collect()), key=str) == want
    assert align.link_tokens(df.limit(0), *PATHS).count() == 0
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = align.link_tokens(docs, *PATHS, chars=100_000).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_texts_without_tokens_alone(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "▁")], "doc_id long, text string")
    assert {tuple(r)[1:] for r in align.link_tokens(df, *PATHS).collect()} == {(0, 0, 0, 0, 0, 0, "")}
