import hashlib
import random
import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from lodestrata.llm import line_dedup

TONGUES = {"en": "the house and the water of this that with which were", "de": "das haus und der wasser nicht mit einer werden auch", "fr": "la maison et les eaux de cette que pour dans être"}
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def write(spark, folder, docs, items):
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def without_boilerplate(docs):
    hosts = {}
    for d in docs:
        hosts.setdefault(d[3], []).append(d)
    out = []
    for of in hosts.values():
        seen = {}
        for d in of:
            for x in {x.strip(" \t\r") for x in (d[1] or "").split("\n")} - {""}:
                seen[x] = seen.get(x, 0) + 1
        drop = {x for x, n in seen.items() if n >= line_dedup.PAGES and n / len(of) > line_dedup.RATIO}
        for d in of:
            text = d[1] if d[1] is None else "\n".join(x for x in d[1].split("\n") if x.strip(" \t\r") not in drop)
            out.append((d[0], text, d[2], d[3], None if text is None else len(text)))
    return out


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def one_of_each(docs):
    """The least of each group of texts whose 5-word shingles have a Jaccard similarity of 0.8 or more."""
    docs = sorted(docs)
    sets, up = [shingles(d[1]) for d in docs], list(range(len(docs)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return [d for k, d in enumerate(docs) if find(k) == k]


def clean(docs, items):
    windows = set()
    for _, t in items:
        w = WORD.findall(lowered(t))
        n = min(10, len(w))
        windows |= {tuple(w[s : s + n]) for s in range(len(w) - n + 1) if n}
    sizes = {len(x) for x in windows}

    def hit(t):
        w = WORD.findall(lowered(t))
        return any(tuple(w[p : p + n]) in windows for n in sizes for p in range(len(w) - n + 1))

    return [d for d in docs if not hit(d[1])]


def coded(docs):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = []
    for i, text, lang, source, n in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids
        out.append((i, lang, source, n, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    return out


def made():
    r = random.Random(11)
    docs = []
    for i in range(150):
        lang = list(TONGUES)[i % 3]
        body = "\n".join(" ".join(r.choice(TONGUES[lang].split()) + (str(r.randrange(50)) if r.random() < 0.3 else "") for _ in range(12)) for _ in range(4))
        docs.append((i, f"shared menu of host{i % 2}\n{body}\n last words ", lang, f"host{i % 2}"))
    junk = "".join(chr(r.choice([1, 2, 3, 14, 15, 127])) for _ in range(600))
    passage = "seven quick foxes of the water were with that house which the others were not"
    docs += [(300, docs[5][1], "fr", "host1"), (301, docs[5][1] + " x9", "fr", "host0"), (302, docs[7][1].replace(" der ", "  DER "), "de", "host1")]
    docs += [(310, junk, None, None), (320, "this is the house with\nthe water: " + passage, "en", "host0"), (321, "the house and the water of this, solo", "en", None)]
    docs += [(330, None, "en", "host0"), (331, "", "en", "host1"), (332, "the house and the water of this that with which were\n" * 900, "en", "new")]
    docs += [(333, docs[-1][1] + "x9", "en", "new")]
    items = [(1, passage), (2, None), (3, "solo"), (4, "!")]
    return [(*d, 7) for d in docs], items, {310}


def test_stages_and_run_against_brute_force(spark, tmp_path):
    docs, items, rejected = made()
    folder = write(spark, tmp_path / "data", docs, items)
    at = [d for d in docs if d[0] not in rejected]
    key = lambda d: d[0]
    brute = [lambda x: [d for d in x if d[0] not in rejected], without_boilerplate, one_of_each, lambda x: clean(x, items), coded]
    at, df = docs, spark.createDataFrame(docs, SCHEMA)
    for (name, stage), want in zip(corpus_pipeline.STAGES, brute, strict=True):
        df, before, at = stage(spark, df, folder), len(at), want(at)
        got = [tuple(r) for r in df.collect()]
        assert sorted(got, key=key) == sorted(at, key=key), name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert df.columns == COLUMNS, name
            df = spark.createDataFrame(got, SCHEMA)
        if name not in ("line_dedup", "bpe_codec"):
            assert len(at) < before, name  # the stage's decision takes effect
    assert not {300, 302, 310, 320, 321, 333} & {d[0] for d in at} and {330, 332} <= {d[0] for d in at}
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()), key=key) == sorted(at, key=key)


def test_stages_of_nothing_nulls_and_repeated_rows(spark, tmp_path):
    odd = [(1, None, None, None, None), (1, None, None, None, None), (2, "", None, "", 0), (None, "solo and more", "en", None, 1), (3, "same words here", "en", "s", 3), (3, "same words here", "en", "s", 3)]
    for k, docs in enumerate(([], odd)):
        folder = write(spark, tmp_path / str(k), docs, [(1, "solo")] if docs else [])
        df = spark.createDataFrame(docs, SCHEMA)
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, df, folder)
            rows = got.collect()
            assert len(rows) <= len(docs), name
            assert name == "bpe_codec" or got.columns == COLUMNS, name
