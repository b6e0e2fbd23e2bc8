"""Hashed terms: odd letters, and texts that have none."""

import lodestrata.plans  # noqa: F401
from lodestrata.operators import embedding as E
from lodestrata.plans import registry

TEXTS = [(1, "D\u0130R two"), (2, "dir two"), (3, "!!"), (4, ""), (5, None)]


def test_a_dotted_capital_i_does_not_split_its_term(spark):
    got = {r.doc_id: r.embedding for r in E.hash_embed(spark.createDataFrame(TEXTS, "doc_id long, text string"), "doc_id", "text", 64).collect()}
    assert got[1] == got[2] and sum(x > 0 for x in got[1]) == 2
    assert all(not any(got[i]) for i in (3, 4, 5))


def test_texts_without_terms_have_no_row(spark, tmp_path):
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r.doc_id for r in registry.QUERIES["e2_hash_embed"](spark, str(tmp_path)).collect()) == [1, 2]
