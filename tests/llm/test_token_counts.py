import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestrata.llm.token_counts import TokenCounter, byte_symbols, count_tokens, merges_needed

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY, OURS = Tokenizer.from_file(PATH), TokenCounter(PATH)


def test_symbols_are_distinct():
    assert len(set(byte_symbols().values())) == 256


def test_merges_by_hand():
    ranks = {("a", "b"): 1, ("b", "c"): 0, ("a", "bc"): 2}
    assert merges_needed(list("abc"), ranks) == 2
    assert merges_needed(list("aab"), ranks) == 1
    assert merges_needed([], ranks) == 0


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abeth in'sdé漢\n\t 12.!  😀")), max_size=60) | st.text(max_size=40))
def test_counts_as_the_library(text):
    text = text.encode("utf-8", "replace").decode()
    assert OURS.count(text) == len(LIBRARY.encode(text, add_special_tokens=False).ids)


def test_special_and_long():
    for text in ("a<|endoftext|>b", "<|endoftext|>" * 3, "x" * 5000, " " * 300 + "a", "ab " * 3000, "<|endof", ""):
        assert OURS.count(text) == len(LIBRARY.encode(text, add_special_tokens=False).ids)


def test_table(spark):
    rows = [(1, None, 7), (2, "", 7), (3, "hello world " * 400, 7), (3, "hello world " * 400, 7)]
    got = count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), PATH).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_tokens, r.over_limit) for r in got][:2] == [(0, 0, False)] * 2
    assert got[2].over_limit and got[2].n_tokens == got[3].n_tokens == 801
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
