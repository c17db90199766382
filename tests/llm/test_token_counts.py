"""Operator 1 against the tokenizers library."""
import public_tokenizers
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from noteweave.llm.token_counts import counter, merged_length, token_counts

SF = "/root/testdata/sf0.001"
LIB = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def lib(text):
    return len(LIB.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aeth in'sreIΣςİéÉ.\n\x1c\x85 <|endoftx>")), max_size=60))
def test_counts_equal_library(text):
    assert counter("word_bpe_49k.json").count(text) == lib(text)


def test_special_strings_and_long_words():
    for text in ["a<|endoftext|>b", "<|startoftext|> <|endoftext|><|endoftext|>", "<|ENDOFTEXT|>", "ΑΣ ΣΑΣ", "x" * 5000, "I'll we've can't", "", " \n", "é ́"]:
        assert counter("word_bpe_49k.json").count(text) == lib(text), text


def test_lowest_rank_first():
    # (1,2)->4 has rank 1, (2,3)->5 has rank 0: the second wins although it stands to the right
    assert merged_length([1, 2, 3], {(1, 2): (1, 4), (2, 3): (0, 5), (1, 5): (2, 6)}) == 1
    assert merged_length([1, 1, 1], {(1, 1): (0, 4)}) == 2


def test_all_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.doc_id: (len(r.text.encode()), lib(r.text)) for r in df.collect()}
    got = token_counts(df).collect()
    assert len(got) == len(want)
    assert all((r.n_bytes, r.n_tokens) == want[r.doc_id] and r.over_limit == (r.n_tokens > 2048) for r in got)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 9), (None, "the cat", 9), (2, "", 9), (2, "", 9), (3, "word " * 3000, 9)], "doc_id long, text string, n_tokens int")
    got = sorted(((r.doc_id or 0), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(df).collect())
    assert got == [(0, 7, 2, False), (1, 0, 0, False), (2, 0, 0, False), (2, 0, 0, False), (3, 15000, 3000, True)]
    assert token_counts(df.limit(0)).collect() == []
