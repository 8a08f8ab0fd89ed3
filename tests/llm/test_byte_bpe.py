import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from ideolens.llm import byte_bpe as B
from ideolens.llm import vocabularies as V

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ALPHABET = st.one_of(st.sampled_from(" \t\n\r 　'srelmtvdaZ19.,!字é́‍"), st.characters(codec="utf-8"))


@pytest.fixture(scope="module")
def encoding():
    with open(RANKS, "rb") as f:
        ranks = V.read_ranks(f.read())
    assert V.PATTERN == public_tokenizers.PATTERN
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(text=st.text(ALPHABET, max_size=120), part=st.integers(1, 20), long=st.integers(1, 40))
def test_parts_do_not_change_the_ids(encoding, text, part, long):
    """However short the parts, and whichever of them are matched by the other regex."""
    assert B.encode_text(encoding, text, part, max(part, long)).tolist() == encoding.encode_ordinary(text)
    assert "".join(V.safe_parts(text, part)) == text


def rows_of(odd_rows, prose):
    texts = [prose(1, 30_000), "don't " * 9000, "字" * 70_000, "a1" * 60_000, " \n" * 30_000 + "x", "'s" * 40_000, "<|endoftext|>", "x" * 40_000 + " " * 40_000 + "y", "é" * 33_000]
    return [(r[0], r[1]) for r in odd_rows] + [(100 + i, t) for i, t in enumerate(texts)]


def test_whole_texts_and_round_trip(spark, encoding, odd_rows, prose):
    rows = rows_of(odd_rows, prose)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = B.decode(B.encode(docs, RANKS), RANKS).collect()
    assert len(out) == len(rows)
    for r in out:
        text = r["text"] or ""
        assert list(memoryview(r["ids"]).cast("I")) == encoding.encode_ordinary(text)
        assert bytes(r["raw"]) == text.encode()


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 700_000 + "a", "x" * 1_000_000 + " y", "=" * 400_000 + "'s"])
def test_runs_that_the_library_cannot_take(encoding, text):
    """A million blanks overflow the library's regex; one match is merged on its own."""
    import regex
    want = [i for m in regex.findall(V.PATTERN, text) for i in encoding._encode_single_piece(m)]
    got = B.encode_text(encoding, text)
    assert got.tolist() == want and encoding.decode_bytes(got.tolist()) == text.encode()


def test_raw_bytes(spark, encoding):
    """Ids need not join to valid UTF-8; many are decoded part by part."""
    ids = encoding.encode_ordinary("字")[:1] * 3
    packed = b"".join(i.to_bytes(4, "little") for i in ids)
    got = B.decode(spark.createDataFrame([(packed,), (b"",), (None,)], "ids binary"), RANKS).collect()
    assert [None if r["raw"] is None else bytes(r["raw"]) for r in got] == [encoding.decode_bytes(ids), b"", None]


def test_empty_and_clashing(empty, clashing):
    assert B.decode(B.encode(empty, RANKS), RANKS).count() == 0
    named = clashing.withColumnRenamed("n", "IDS")
    out = B.encode(named, RANKS)
    assert out.columns.count("ids") == 1 and "IDS" not in out.columns and out.count() == named.count()


def test_a_file_that_is_too_large(spark, tmp_path, monkeypatch):
    (tmp_path / "ranks").write_bytes(b"YQ== 0\n" * 10)
    monkeypatch.setattr(V, "MAX_BYTES", 20)
    with pytest.raises(ValueError):
        V.ship(spark, str(tmp_path / "ranks"), B.build)
