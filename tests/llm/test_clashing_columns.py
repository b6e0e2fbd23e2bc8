"""Stages of the pipeline over documents with columns of the names that the stages use inside."""

import public_tokenizers
from pyspark.sql import functions as F

from lodestrata.llm import bpe_codec, common, decontaminate, language_id, line_dedup, near_copies

EXTRA = ["_host", "_lines", "_kept", "_id", "_h", "_H_", "_coded", "_deal", "_copy", "key", "h", "row", "digest", "first", "scores", "best"]


def test_stages_keep_columns_of_clashing_names(spark, monkeypatch):
    words = "the river runs past the old mill and on to the sea where gulls wait for boats".split()
    texts = [" ".join(words[i:] + words[:i]) + f" item{i}" for i in range(6)]
    texts += [texts[0], "one two three four five six seven eight nine ten eleven"]
    docs = spark.createDataFrame([(i, t + "\nfooter", "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    more = docs.select("*", *(F.lit(c).alias(c) for c in EXTRA))
    bench = spark.createDataFrame([(1, "two three four five six seven eight nine ten eleven")], "item_id long, text string")
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    stages = {
        "language": language_id.accepted,
        "lines": lambda d: line_dedup.without_boilerplate(d),
        "copies": near_copies.one_of_each,
        "benchmark": lambda d: decontaminate.without_contaminated(d, bench),
        "codes": lambda d: bpe_codec.code_digests(d, vocabulary),
    }

    def same():
        for name, stage in stages.items():
            plain, got = stage(docs), stage(more)
            assert set(EXTRA) <= set(got.columns), name
            assert got.filter(" or ".join(f"`{c}` <> '{c}'" for c in EXTRA)).count() == 0, name
            assert sorted(map(str, got.select(*plain.columns).collect())) == sorted(map(str, plain.collect())), name

    same()
    assert sorted(r.doc_id for r in near_copies.one_of_each(more).collect()) == [0, 1, 2, 3, 4, 5, 7]
    assert sorted(r.doc_id for r in decontaminate.without_contaminated(more, bench).collect()) == list(range(7))
    assert more.transform(line_dedup.without_boilerplate).filter(F.col("text").contains("footer")).count() == 0
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    stages = {"lines": stages["lines"]}
    same()
