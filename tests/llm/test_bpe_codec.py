import hashlib

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestrata.llm.bpe_codec import READ, Codec, Decoder, Kept, code_digests, decode, encode, merge_all, sufficient_lookahead

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY, OURS = Tokenizer.from_file(PATH), Codec(PATH)


def library(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def test_lookahead_of_a_small_list():
    # bc is taken before ab, and cd before bc: whether ab merges shows two symbols on
    assert sufficient_lookahead([("c", "d"), ("b", "c"), ("a", "b")], "")[0] >= 2


def test_stream_equals_whole():
    import random

    r = random.Random(5)
    for n in (1, 10, 700, 705, 3000, 20000):
        word = "".join(r.choice("etaoinsh") for _ in range(n))
        symbols = [OURS.names[b] for b in word.encode()]
        symbols[-1] += OURS.end
        for step in (1, 7, 997):
            assert list(OURS.stream(word[i : i + step] for i in range(0, n, step))) == merge_all(symbols, OURS.ranks)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abeth in'sdÉéΣ漢\n\t 12.! <|>")), max_size=60))
def test_encodes_as_the_library(text):
    assert OURS.encode(text) == " ".join(map(str, library(text)))


def test_decoder_modes():
    for text in ("a é 漢 😀", "one<|endoftext|>two", ""):
        ids = library(text)
        d = Decoder(OURS)
        assert "".join(map(d.feed, ids)) == LIBRARY.decode(ids, skip_special_tokens=False)
        for as_tokens in (True, False):  # runs of any length give what single ids give
            one, many = Decoder(OURS, as_tokens), Decoder(OURS, as_tokens)
            assert "".join(map(one.feed, ids)) + one.flush() == "".join(many.feed_run(ids[i : i + 2]) for i in range(0, len(ids), 2)) + many.flush()
    d = Decoder(OURS, as_tokens=False)
    assert "".join(map(d.feed, library("Été 漢字 😀 x"))) + d.flush() == "été 漢字 😀 x "


def test_tables(spark):
    rows = [(1, None), (2, ""), (3, "Hello  WORLD <|startoftext|> é"), (3, "Hello  WORLD <|startoftext|> é"), (4, "long" * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in code_digests(df, PATH).collect():
        ids = library(r.text or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = df.select("text", encode(df.text, PATH).alias("ids"))
    for r in back.select("text", "ids", decode(back.ids, PATH).alias("out")).collect():
        assert r.ids == library(r.text or "") and r.out == LIBRARY.decode(r.ids, skip_special_tokens=False)
    assert code_digests(df.limit(0), PATH).count() == 0


def test_long_texts_without_spaces():
    """Texts far beyond what is read at a time, of one word, of words without spaces, and of other white space only."""
    import random

    n, r = READ * 3, random.Random(8)
    odd = "".join(r.choice("abé漢😀1-.,ΣßŸ́") for _ in range(n))
    for text in ("x" * n, "ab12" * n, odd, "\n".join("word%d" % i for i in range(n // 4)), "a b " * n, ("y" * (n // 2) + " ") * 3, " " * n + "end"):
        want, runs = library(text), list(OURS.pieces(text))
        assert [int(i) for run in runs for i in run.split()] == want
        assert not want or max(len(run) for run in runs) <= 20 * READ


def test_a_word_is_kept_once():
    """However a word is written and whatever stands beside it, a worker keeps its code once, and no text between two spaces."""
    c = Codec(PATH)
    text = "Tree tree, TREE. (tree) tree; Árbol árbol, ÁRBOL."
    assert c.encode(text) == " ".join(map(str, library(text)))
    kept = [k for v in vars(c).values() if isinstance(v, Kept) for k in v]
    assert sorted(k for k in kept if "r" in k) == ["tree", "árbol"]
