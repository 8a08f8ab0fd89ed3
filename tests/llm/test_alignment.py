import collections
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from ideolens.llm import alignment as L

A_FILE, B_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD_TEXTS = ["a", " ", "  ", "a ", " a", "a  ", "a  b", "a　 b c", "a\u0085 b", "x  y", "he said “no” – yes… so", "a▁b c", "▁", "x ▁ y z",
             "<|endoftext|> and <s> </s> <unk> <0x41>", "end<|endoftext|>", "\U0001f600 \U0001f600\U0001f600 ok", "nul\0 byte \0", "a\r\n b\n\n c\t d \n", "0123456789 12 3",
             "don't we'll I'D 's", "字字 字 漢字。 と", "слово слово слово", "é ́ x", "​ ​", "᠎ x", "\x1c x\x1f y", "a" * 3000, "^" * 500 + " " * 500 + "b",
             "ab " * 700, "­ soft­ hyphen", "ﬁ ligature ½ ①", "﻿ bom", "tab\t\t x", "a" + " " * 40 + "b" + " " * 41]


@pytest.fixture(scope="module")
def models():
    a = tokenizers.Tokenizer.from_file(A_FILE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B_FILE)
    alphabet = L.byte_alphabet()
    return a, b, alphabet


def whole(models, text):
    """Ids and bytes of the whole text by both libraries, or None."""
    a, b, alphabet = models
    if not text:
        return None
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    raw_a = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ids_a]
    raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    same = b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode()
    return (ids_a, ids_b, np.cumsum([len(x) for x in raw_a]).tolist(), np.cumsum([len(x) for x in raw_b]).tolist()) if same else None


def brute(models, texts):
    docs, counts = [], collections.Counter()
    for text in texts:
        got = whole(models, text)
        if got is None:
            docs.append(None)
            continue
        ids_a, ids_b, ends_a, ends_b = got
        cuts = sorted(set(ends_a) & set(ends_b))
        groups, pairs, i, j = [], [], 0, 0
        for cut in cuts:
            p, q = ends_a.index(cut) + 1, ends_b.index(cut) + 1
            groups.append(",".join(map(str, ids_a[i:p])) + "|" + ",".join(map(str, ids_b[j:q])))
            for x in range(i, p):
                for y in range(j, q):
                    if max(ends_a[x - 1] if x else 0, ends_b[y - 1] if y else 0) < min(ends_a[x], ends_b[y]):
                        pairs.append((ids_a[x], ids_b[y]))
            i, j = p, q
        counts.update(set(pairs))
        docs.append((len(ids_a), len(ids_b), groups, pairs))
    top = collections.Counter()
    for (a, _), n in counts.items():
        top[a] = max(top[a], n)
    return [(0,) * 6 + ("",) if d is None else (d[0], d[1], len(d[2]), len(d[3]), sum(counts[p] == top[p[0]] for p in d[3]),
                                                 sum(counts[p] for p in d[3]), ";".join(d[2])) for d in docs]


@pytest.fixture(scope="module")
def texts(odd_rows, prose):
    return [r[1] for r in odd_rows] + ODD_TEXTS + [prose(i, 20) for i in range(30)] + [None, ""]


@pytest.mark.parametrize("frequent", [None, 40, 0])
def test_brute_force(spark, models, texts, frequent):
    """Also when most pairs are looked up by a join."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    names = [x.split()[0] for x in L.FIELDS.split(", ")]
    got = {r["doc_id"]: tuple(r[n] for n in names) for r in L.align(docs, A_FILE, B_FILE, frequent).collect()}
    for i, want in enumerate(brute(models, texts)):
        assert got[i] == want, repr(texts[i])[:80]


@pytest.fixture(scope="module")
def aligner():
    with open(A_FILE, "rb") as a, open(B_FILE, "rb") as b:
        return L.Aligner(L.ByteLevel(a.read()), L.Pieces(b.read()), 500)


def tokens(aligner, texts):
    out = []
    for _, n, place, owner in aligner.chunks(pa.array(texts, pa.string())):
        (a, at_a, _), (b, at_b, _) = aligner.tokens(n, place, owner)
        out += [(a[at_a[i]:at_a[i + 1]].tolist(), b[at_b[i]:at_b[i + 1]].tolist()) for i in range(n)]
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \t\n 　 ▁'sa1.é字"), st.characters(codec="utf-8")), max_size=25), min_size=1, max_size=8))
def test_chunks_have_the_tokens_of_whole_texts(models, aligner, own):
    """Chunks encoded together, alone, remembered or forgotten give the library's tokens."""
    for text, got in zip(own, tokens(aligner, own)):
        want = whole(models, text)
        assert got == (([], []) if want is None else want[:2])


@settings(max_examples=200, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \t\n\r\x0b\x1c\x85\xa0'srelmtvd19.,!\xad²½ªµ"), st.characters(max_codepoint=0x24F, codec="utf-8")), min_size=1, max_size=60))
def test_ranks_and_merges_agree_on_latin_text(models, aligner, text):
    assert aligner.a.ranked is not None
    assert aligner.a.encode(" " + text) == models[0].encode(" " + text, add_special_tokens=False).ids


def test_long_runs(models, aligner):
    """Runs of blanks that the faster library's regex cannot take at once."""
    own = ["a" + " " * 300_000 + "b", "\n" * 400_000, "é" * 100_000]
    for text, got in zip(own, tokens(aligner, own)):
        want = whole(models, text)
        assert got == (([], []) if want is None else want[:2])


def test_vocabularies_that_cut_nowhere(models, texts):
    with open(A_FILE, "rb") as a, open(B_FILE, "rb") as b:
        aligner = L.Aligner(L.ByteLevel(a.read()), L.Pieces(b.read()))
    aligner.cut = False
    own = [t for t in texts if t is None or len(t) < 4000]
    for text, got in zip(own, tokens(aligner, own)):
        want = whole(models, text)
        assert got == (([], []) if want is None else want[:2])


@pytest.mark.parametrize("seed", range(30))
def test_shared_cuts(seed):
    """Against the plain intersection; long stretches without a shared end too."""
    rng = random.Random(seed)
    ends_a, ends_b, bounds_a, bounds_b, at = [0], [0], [0], [0], 0
    for _ in range(rng.randrange(1, 9)):
        size = rng.choice((0, 1, 2, 7, 60, 900))
        for ends, density in ((ends_a, rng.choice((0.02, 0.3, 1))), (ends_b, rng.choice((0.02, 0.3, 1)))):
            ends += [at + x for x in range(1, size) if rng.random() < density] + [at + size] * (size > 0)
        at += size
        bounds_a.append(len(ends_a) - 1)
        bounds_b.append(len(ends_b) - 1)
    a, b = np.array(ends_a), np.array(ends_b)
    cuts_a, cuts_b = L.shared_cuts(a, b, np.array(bounds_a), np.array(bounds_b))
    want = sorted((set(ends_a) & set(ends_b)) - {0})
    assert a[cuts_a].tolist() == want and b[cuts_b].tolist() == want


def test_every_part_of_a_shared_stretch(models):
    """Text of which neither vocabulary ends a token where the other does for long."""
    a, b = np.arange(0, 6001, 2), np.concatenate((np.arange(0, 5999, 3) + 1, [6000]))
    a, b = a[(a % 6 != 4) | (a == 6000)], np.concatenate(([0], b[(b % 6 == 1) | (b == 6000)]))
    cuts_a, cuts_b = L.shared_cuts(a, b, np.array([0, len(a) - 1]), np.array([0, len(b) - 1]))
    assert a[cuts_a].tolist() == b[cuts_b].tolist() == [6000]


def test_empty_and_clashing(empty, clashing, spark):
    out = L.align(empty, A_FILE, B_FILE)
    assert out.count() == 0 and out.columns[:5] == empty.columns
    named = clashing.withColumnRenamed("size", "N_A").withColumnRenamed("row", "key").drop("key")
    out = L.align(named, A_FILE, B_FILE)
    assert out.count() == named.count() and "n_a" in out.columns and "N_A" not in out.columns
