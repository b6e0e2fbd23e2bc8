import random

import corpus_pipeline
from lodestrata.llm import near_copies, simhash


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def kept_of(rows):
    """Ids that stay, by brute force over all pairs of 5-word Jaccard >= 0.8."""
    rows = sorted(rows)
    sets, up = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {rows[k][0] for k in range(len(rows)) if find(k) == k}


def near_texts():
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    common = " ".join(r.choice(vocabulary) for _ in range(12))
    texts = [None, "", " \n", "one", "One two", "one two three four five"]
    for _ in range(25):
        base = [r.choice(vocabulary) for _ in range(r.choice([8, 30, 150, 400]))]
        for _ in range(6):
            t = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 40))):
                t[r.randrange(len(t))] = r.choice(vocabulary)
            texts.append((common + " " if r.random() < 0.5 else "") + " ".join(t[r.randint(0, 2) :]))
    base = [r.choice(vocabulary) for _ in range(200)]
    texts += [" ".join(base[: r.randint(190, 200)] + [r.choice(vocabulary) for _ in range(r.randint(0, 9))]) for _ in range(60)]
    rows = [(3 * i + 1, t) for i, t in enumerate(texts)]
    r.shuffle(rows)
    return rows


def test_pipeline_stage_drops_all_near_copies(spark, monkeypatch):
    rows = near_texts()
    want = kept_of(rows)
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for sample in (near_copies.SAMPLE, 0):  # the order of the shingles does not change the result
        monkeypatch.setattr(near_copies, "SAMPLE", sample)
        kept = corpus_pipeline.drop_near_duplicates(spark, df, "")
        assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} == want
    assert near_copies.one_of_each(df.limit(0)).count() == 0


def test_rows_are_judged_one_by_one(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (4, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (7, None), (8, ""), (2, "other"), (9, "other"), (5, "q r s"), (5, "q r s"), (1, "x y z"), (3, "x y z"), (3, "third")]
    df = spark.createDataFrame([(i, t, 0, "c") for i, t in rows], "doc_id long, text string, h long, first string")
    kept = near_copies.one_of_each(df)
    got = sorted(((x.doc_id, x.text) for x in kept.collect()), key=str)
    assert kept.columns == df.columns
    assert got == sorted([(None, "a b c d e f")] * 2 + [(2, "a b c d e f"), (7, None), (2, "other"), (5, "q r s"), (1, "x y z"), (3, "third")], key=str)


def test_covering_tables_change_nothing_but_the_order(spark, monkeypatch):
    """Without any pair from the covering tables the groups are the same."""
    rows = near_texts()[:120]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, near_copies.near_copies(df).collect()))
    monkeypatch.setattr(simhash, "links", lambda nodes, radius: nodes.select(nodes.node.alias("a"), nodes.node.alias("b")).limit(0))
    assert sorted(map(tuple, near_copies.near_copies(df).collect())) == want
