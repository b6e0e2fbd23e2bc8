import base64
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import decontaminate, language_id, license_scan, line_dedup, pii, warc
from lodestrata.llm.common import ascii_lower

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute_hits(text, items):
    w, hit, named = words(text), set(), set()
    for item, t in items:
        x = words(t)
        if not x:
            continue
        n = min(10, len(x))
        for s in range(len(x) - n + 1):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == x[s : s + n]:
                    hit.update(range(p, p + n))
                    named.add("null" if item is None else str(item))
    return len(w), len(hit), sorted(named)


def test_contamination(spark):
    passage = " ".join(f"Word{i}" for i in range(14))
    items = [(10, passage), (9, "alpha beta"), (8, "solo"), (7, None), (6, "!!"), (5, "the " * 12), (10, passage.upper()), (None, "nothing here at all")]
    docs = [
        (1, "intro, " + passage + "; outro"),
        (2, passage.lower().replace(" ", "--")),
        (3, " ".join(passage.split()[:9])),
        (4, "É alpha, BETA solo solo"),
        (5, None),
        (6, ""),
        (7, "the " * 30),
        (8, "x " * 3000 + passage + " y" * 3000),
        (8, "another row of the same id: alpha beta"),
        (9, "nothing here at all"),
        (None, "solo"),
    ]
    df = spark.createDataFrame([(*d, 3) for d in docs], "doc_id long, text string, n_words int")
    got = decontaminate.contamination(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(got) == len(docs)
    want = sorted((d or -1, *brute_hits(t, items)[:2], hashlib.sha256(",".join(brute_hits(t, items)[2]).encode()).hexdigest()) for d, t in docs)
    assert sorted((r.doc_id or -1, r.n_words, r.n_hit, r.items_sha256) for r in got) == want
    assert all(r.contaminated == (r.n_hit > 0) for r in got)
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in decontaminate.contamination(df, none).collect())
    assert decontaminate.contamination(df.limit(0), none).count() == 0
    kept = decontaminate.without_contaminated(df, spark.createDataFrame(items[:1], "item_id long, text string"))
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 3, 4, 5, 6, 7, 8, 9]  # of the two rows 8 the clean one


def test_lines(spark):
    rows = [(i, f"menu \nbody {i}\n\nfoot{'' if i % 2 else 'er'}", "a", 0) for i in range(20)] + [(50, "menu\nx", "b", 0), (51, None, "a", 0), (52, "menu\n menu", None, 0), (53, "", "a", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_lines int")
    got = {r.doc_id: r for r in line_dedup.without_boilerplate(df, ratio=0.48).collect()}
    assert got[0].text == "body 0\n\nfooter" and (got[0].n_lines, got[0].n_dropped) == (4, 1)  # 10 of 22 is not over the ratio
    assert got[50].text == "menu\nx" and got[51].text is None and got[51].n_lines == 0 and got[52].text == "menu\n menu" and got[53].text == ""
    assert line_dedup.without_boilerplate(df.limit(0)).count() == 0


def test_lines_by_ratio(spark):
    """The same ratio for hosts of any size: a line on exactly a tenth of the pages stays, one on more goes."""
    rows, want = [], {}
    for host, n in (("tiny", 6), ("small", 60), ("middle", 100), ("large", 3000)):
        held = {"under": n * 9 // 100, "at": n // 10, "over": n * 11 // 100, "some": 5}
        for i in range(n):
            rows.append((len(rows), "\n".join([f"body {host} {i}"] + [k for k, m in held.items() if i < m]), host))
        want |= {(host, k): 0 if m >= 5 and m / n > 0.1 else m for k, m in held.items()}
    got = line_dedup.without_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    seen = {key: 0 for key in want}
    for r in got:
        for line in r.text.split("\n"):
            if (r.source, line) in seen:
                seen[r.source, line] += 1
    assert seen == want
    assert want["middle", "under"] == 9 and want["middle", "at"] == 10 and want["middle", "over"] == 0 and want["tiny", "some"] == 0


def test_lower_case_of_every_character(spark):
    """A-Z alone are lower-cased, whichever Unicode the engine knows."""
    points = [[chr(c) for c in range(a, a + 4096) if not 0xD800 <= c < 0xE000] for a in range(0, 0x110000, 4096)]
    df = spark.createDataFrame([(p,) for p in points if p], "c array<string>").select(F.explode("c").alias("c"))
    wrong = df.filter(ascii_lower(F.col("c")) != F.when(F.col("c").between("A", "Z") & (F.length("c") == 1) & (F.ascii("c") < 91), F.char(F.ascii("c") + 32)).otherwise(F.col("c")))
    assert wrong.count() == 0
    clean = spark.createDataFrame([(1, "\u2c2f a b")], "doc_id long, text string")
    item = spark.createDataFrame([(1, "\u2c5f a b")], "item_id long, text string")
    assert not decontaminate.contamination(clean, item).first().contaminated


def brute_licenses(text):
    """{license: (best coefficient, first word of the first best run)} over all runs of each template's length."""
    w, out = words(text), {}
    b = list(zip(w, w[1:], strict=False))
    for name, t in license_scan.TEMPLATES.items():
        tb, n = set(license_scan.bigrams_of_template(t)), len(license_scan.words_of_template(t)) - 1
        for i, x in enumerate(b):
            if x in tb:
                run = set(b[i : i + n])
                d = 2 * len(run & tb) / (len(run) + len(tb))
                if d >= license_scan.DICE and d > out.get(name, (0,))[0]:
                    out[name] = (d, i)
    return out


def wrapped(text, width, lead):
    lines, line = [], lead
    for w in text.split():
        if len(line) + len(w) >= width:
            lines.append(line)
            line = lead
        line += " " + w
    return "\n".join([*lines, line])


def test_licenses(spark):
    T = license_scan.TEMPLATES
    mit = "MIT License\n\nCopyright (c) 2021 A. N. Other\n\n" + wrapped(T["MIT-text"], 78, "")
    rows = [(1, "x x x x a b c d\nReleased under the MIT License.\ny e f g h i"), (2, T["MIT-header"].replace(" the ", "\nthe ").upper()), (3, None), (4, ""), (5, "word " * 5000), (6, "released under the mit licence"), (7, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0"), (1, "é"), (8, "one"),
            (9, mit), (10, "import a\n" * 40 + wrapped(T["Apache-2.0-header"], 72, " *") + "\n */\nint main() { return 0; }\n" * 30), (11, "It was, in short, a line that says: released under the MIT License, and then it goes on for many more words than that"),
            (12, wrapped(T["BSD-3-Clause"], 70, "#").replace("copyright holder", "University of Somewhere")), (13, wrapped(T["ISC"], 60, "//")), (14, "a b " * 30000 + wrapped(T["GPL-3.0-header"], 60, "//") + " c d" * 30000)]
    got = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, {m.license: (round(m.dice, 9), m.word) for m in r.matches}) for r in got if r.doc_id != 1) == sorted((i, {k: (round(d, 9), s) for k, (d, s) in brute_licenses(t).items()}) for i, t in rows if i != 1)
    by = {r.doc_id: r for r in got}
    assert by[9].best_license in ("MIT-header", "MIT-text") and "MIT-text" in by[9].licenses and "Apache-2.0-header" in by[10].licenses and by[11].licenses == "MIT"
    assert "BSD-3-Clause" in by[12].licenses and by[13].licenses == "ISC" and "GPL-3.0-header" in by[14].licenses
    assert by[2].licenses == "MIT-header" and by[3].best_license is None and all(by[i].n_matches == 0 for i in (3, 4, 5, 6, 8)) and len(got) == len(rows)
    assert license_scan.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_recall_of_changed_licences(spark):
    """Whole licences and headers, wrapped anew, with a word in twenty changed and set in other text: all are found."""
    r = random.Random(7)
    names = [n for n, t in license_scan.TEMPLATES.items() if len(t.split()) >= 30]
    rows = []
    for k in range(60):
        w = license_scan.TEMPLATES[names[k % len(names)]].split()
        for i in r.sample(range(len(w)), len(w) // 20):
            w[i] = "changed"
        rows.append((k, "lead words here " * r.randrange(40) + "\n" + wrapped(" ".join(w), r.randrange(40, 90), r.choice(["", "#", " *", "//"])) + "\nafter all " * r.randrange(40)))
    got = {x.doc_id: x.licenses.split(",") for x in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(names[k % len(names)] in got[k] for k in got)


def test_warc(spark):
    long = ("é漢x" * 1000)[:2500]
    rows = [(1, "u 1", "same"), (2, "u", "same"), (3, None, None), (4, "u", ""), (5, "u", long), (6, "u", "a\r\n\r\nWARC/1.1\r\nb" * 3), (7, "u", "\r\n\r\n"), (8, "u", long), (9, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\n"), (10, "u", "x\r\n\r\nWARC/1.1")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for segment, compression in ((1 << 20, "gzip"), (64, "none"), (7, "none")):
        got = {r.page_id: r for r in warc.round_trip(df, segment=segment, compression=compression).collect()}
        assert len(got) == len(rows)
        last = {}
        for i, _, h in rows:
            last[h or ""] = i
        for i, _, h in rows:
            data = (h or "").encode()
            assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
            first = last[h or ""]
            assert (got[i].record_type, got[i].refers_to) == (("response", None) if first == i else ("revisit", first))
    assert warc.round_trip(df.limit(0)).count() == 0


def test_chunk_table(spark):
    df = spark.createDataFrame([(1, "x" * 1000), (2, "y")], "page_id long, html string")
    path = warc.new_path(spark, "warc-test")
    warc.write_archives(warc.records(df, "page_id", "html"), path, 100, "none")
    chunks = warc.read_chunks(spark, path).cache()
    of = sorted(chunks.filter("id = '1'").collect(), key=lambda r: r.chunk)
    assert [len(r.block) for r in of] == [100] * 10 and b"".join(bytes(r.block) for r in of) == b"x" * 1000
    for r in warc.carried_digests(chunks).collect():
        assert r.digest_so_far == hashlib.sha1(b"x" * 100 * (r.chunk + 1)).hexdigest() and r.bytes_so_far == 100 * (r.chunk + 1)


def test_warc_urls_beyond_ascii(spark):
    rows = [(1, "http://a/é漢😀", "body one, é"), (2, "http://ü.de/" + "é" * 40, "x\r\n\r\ny" * 30), (3, "http://a/é", ""), (4, "http://a", "plain")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for segment in (1 << 20, 16):  # the second writes long payloads in segments
        got = {r.page_id: r for r in warc.round_trip(df, segment=segment, compression="none").collect()}
        assert {i: (r.payload_bytes, r.payload_digest) for i, r in got.items()} == {i: (len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()) for i, _, h in rows}


def test_warc_null_and_repeated_ids(spark):
    long, other = "ab\r\n\r\nWARC/1.1\r\n" * 40, "é" * 300
    rows = [(None, long), (None, other), (3, long), (3, long), (3, "short"), (4, other), (4, None), (None, None), (7, "x" * 500), (7, "y" * 500), (None, "alone" * 60)]
    df = spark.createDataFrame([(i, "u", h, "clash", 0) for i, h in rows], "page_id long, url string, html string, record string, n long")
    b32 = lambda h: base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
    want = []
    for i, h in rows:
        h = h or ""
        first = max((j for j, x in rows if (x or "") == h and j is not None), default=None)
        again = first is not None and (i is None or i < first)
        want.append((i, len(h.encode()), b32(h), "revisit" if again else "response", first if again else None))
    key = lambda r: tuple(map(str, r))
    for segment in (1 << 20, 64, 7):
        got = [tuple(r) for r in warc.round_trip(df, segment=segment, compression="none").collect()]
        assert sorted(got, key=key) == sorted(want, key=key)


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_base(t):
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card":
                total = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d)))
                if not 16 <= len(d) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


TEXTS = [
    None,
    "",
    "no data",
    "é a.b@c.d.e, x@y and a@b@c.com p@q.r_s@t.u",
    "1.2.3.4.5.6.7.8 999.1.1.1 00255.1.1.1 1.2.3 111.1.1.1111",
    "4111 1111 1111 1111 4111-1111-1111-1112 4075484814472302 12345678901234567890",
    "call +1 (779) 555-7898 or +12 or +1 23 456 789 0123 456 7",
    "card 411111111111111 tel 555-123-4567 mail joe (at) example (dot) com version 123.456.7890",
    "@" * 50 + "a" * 3000 + "@x.y " + "9" * 3000,
]


def test_personal_data(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] * 2, "doc_id long, text string")
    got = pii.find_personal_data(df).collect()
    assert len(got) == 2 * len(TEXTS)
    for r in got:
        base = brute_base(TEXTS[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b.startswith(k) for b in base) for k in BASE]
        spans = r.spans.split(",") if r.spans else []
        assert set(base) <= set(spans)
        keys = [(list(BASE).index(s.split(":")[0]), int(s.split(":")[1])) for s in spans]
        assert keys == sorted(keys)
    assert pii.find_personal_data(df.limit(0)).count() == 0


def luhn_number(r, lead, n):
    d = lead + "".join(r.choice("0123456789") for _ in range(n - 1 - len(lead)))
    return next(d + c for c in "0123456789" if pii.luhn(d + c))


def labelled(r):
    """(text, span, kind or None): added spans that are personal data, and look-alikes that are none."""
    name, dom = r.choice(["anna", "john.smith", "m_weber", "p.dupont", "info"]), r.choice(["mail", "example", "uni-site", "shop"])
    ten = f"{r.randrange(2, 9)}{r.randrange(0, 9)}{r.randrange(2, 9)}", f"{r.randrange(2, 9)}{r.randrange(10, 99)}", f"{r.randrange(1000, 9999)}"
    good = [
        ("email", r.choice(["write to {} today", "contact: {}", "you reach me via {} or by post", "my mail is {}"]), r.choice([f"{name} (at) {dom} (dot) com", f"{name}[at]{dom}[dot]org", f"{name}(at){dom}.net", f"{name} at {dom} dot de"])),
        ("phone", r.choice(["call {} now", "phone {}", "my mobile is {} and", "tel. {}"]), r.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}"]).format(*ten)),
        ("phone", r.choice(["phone: {} (evenings)", "call {} please"]), f"0{r.choice(['30', '171', '40', '89'])} {r.randrange(2000000, 9999999)}"),
        ("card", r.choice(["paid by card {} yesterday", "visa {} expires soon", "my credit card {}"]), r.choice([luhn_number(r, "37", 15), luhn_number(r, "36", 14), luhn_number(r, "4", 13)])),
        ("ip", r.choice(["login from host {} failed", "the server {} answers"]), f"{r.randrange(11, 120)}[.]{r.randrange(256)}[.]{r.randrange(256)}[.]{r.randrange(1, 255)}"),
    ]
    number = "".join(r.choice("123456789") for _ in range(15))
    bad = [
        (None, r.choice(["order no {} was sent", "serial {} of this part", "invoice {} is open", "isbn {} in print"]), number if not pii.luhn(number) else number[:-1] + str((int(number[-1]) + 1) % 10)),
        (None, r.choice(["version {} is out", "build {} of the part no series"]), f"{r.randrange(100, 199)}-{r.randrange(100, 199)}-{r.randrange(1000, 9999)}"),
        (None, r.choice(["token={} in the log", "hash {} of it"]), "9" * 16),
        (None, "serial id_{} and more", f"{r.randrange(100, 199)}-{r.randrange(100, 199)}-{r.randrange(1000, 9999)}"),
    ]
    kind, frame, span = r.choice(good if r.random() < 0.5 else bad)
    return frame.format(span), frame.index("{"), span, kind


def test_added_spans_of_labelled_rows(spark):
    """Recall of added spans is 0.9 at least on held-out labelled rows, and nine in ten added spans are right."""
    r = random.Random(11)
    rows = [labelled(r) for _ in range(1500)]
    fill = [f"Mail joe{i}@site{i % 7}.com or call +49 30 {1000000 + i}, host 10.{i % 250}.3.4, card {luhn_number(r, '4', 16)} of visa." for i in range(300)]
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(rows)] + [(10000 + i, t) for i, t in enumerate(fill)], "doc_id long, text string")
    got = {x.doc_id: {(f.kind, f.start, f.end) for f in x.found} for x in pii.find_personal_data(df).collect()}
    hit, true, added, right = {}, {}, 0, 0
    for i, (_, at, span, kind) in enumerate(rows):
        want = (kind, at, at + len(span))
        added += len(got[i])
        right += want in got[i]
        if kind:
            true[kind] = true.get(kind, 0) + 1
            hit[kind] = hit.get(kind, 0) + (want in got[i])
    assert sum(hit.values()) >= 0.9 * sum(true.values()) and all(hit[k] >= 0.8 * true[k] for k in true), (hit, true)
    assert right >= 0.9 * added, (right, added)


def test_personal_data_takes_linear_time():
    """A hundred times the text takes about a hundred times as long, whatever it holds."""
    import time

    for unit in ("a" * 50, "a(at)", "aaaa (at) bbbb ", "1.1.1.1 a@b.c ", "+1 ( ( ", "555-123-4567 ", "1 2 3 4 5 6 7 8 9 0 1 2 3 ", " at x dot y"):
        took = []
        for n in (100, 10_000):
            t = time.perf_counter()
            for k, s, e, _ in pii.spans_of("x(at " + unit * n):
                pii.votes(unit * 100, k, 0, 10)
            took.append(time.perf_counter() - t)
        assert took[1] < 100 * max(took[0], 1e-3) * 6, (unit, took)


def test_reliabilities_of_labelers():
    """Labelers that say what most say come out reliable; patterns of votes for and against part."""
    patterns = [("card", "11111", 300), ("card", "11-11", 200), ("card", "1111-"[:4] + "0", 20), ("card", "00000", 300), ("card", "000-0", 200), ("card", "10001", 20)]
    soft, rate = pii.reliabilities(patterns)
    assert soft["card", "11111"] > 0.95 > 0.05 > soft["card", "00000"] and all(rate[0, j, 1] > rate[0, j, 0] for j in range(len(pii.LABELERS)))
    text = "paid by card 4111 1111 1111 1111 today"
    good, bad = pii.features(text, "card", 13, 32, "11111"), pii.features("serial 1234 5678 9012 345x", "card", 7, 25, "00000")
    w = pii.span_classifier([(good, soft["card", "11111"])] * 50 + [(bad, soft["card", "00000"])] * 50)
    assert sum(w[k] for k in good) > 0 > sum(w[k] for k in bad)


TONGUES = {"en": "the house and the water of this that with which were", "de": "das haus und der wasser nicht mit einer werden auch", "fr": "la maison et les eaux de cette que pour dans être"}


def test_language(spark):
    import random

    r = random.Random(0)
    rows = []
    for i in range(240):
        lang = list(TONGUES)[i % 3]
        rows.append((i, " ".join(r.choice(TONGUES[lang].split()) for _ in range(30)), lang, f"h{i % 3}"))
    held = [(1000 + i, " ".join(r.choice(TONGUES[lang].split()) for _ in range(12)), None, None) for i, lang in enumerate(TONGUES)]
    odd = [(2000, None, "de", "h1"), (2001, "", None, None), (2002, "\x00\x01\x7f" * 60, None, None), (2003, "0 1 2", "xx", "new")]
    df = spark.createDataFrame(rows + held + odd, "doc_id long, text string, lang string, source string")
    got = {x.doc_id: x for x in language_id.identify(df, sample=50).collect()}
    assert len(got) == df.count()
    assert all(got[i].language == lang and got[i].accepted for i, _, lang, _ in rows)
    assert [got[1000 + k].language for k in range(3)] == list(TONGUES)
    assert got[2000].language == "de" and not got[2002].accepted
    kept = language_id.accepted(df, sample=50)
    assert kept.columns == df.columns and 2002 not in {x.doc_id for x in kept.collect()}
    blank = language_id.identify(df.limit(0)).collect()
    assert blank == []
    assert not any(x.accepted for x in language_id.identify(df.withColumn("lang", df.lang.cast("string").substr(9, 1)).filter("doc_id < 0")).collect())


def test_language_evidence_is_summed(spark):
    """The posterior of one row against the sum by hand."""
    import numpy as np

    rows = [(i, t, lang, "h") for i, (lang, t) in enumerate([("en", TONGUES["en"])] * 6 + [("de", TONGUES["de"])] * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    languages, table = language_id.fit(df, "text", "lang", "doc_id")
    s = np.array(language_id.text_scores(TONGUES["de"], table))
    c, T = np.array([3.0, 6.0, 0.0]), language_id.TABLE
    base = np.append((1 - language_id.NONE_PRIOR) * (c[:2] + T) / (9 + 2 * T), language_id.NONE_PRIOR)
    suffix = (c + language_id.SUFFIX * base) / (9 + language_id.SUFFIX)
    host = (c + language_id.HOST * suffix) / (9 + language_id.HOST)
    declared = np.log(np.array([(3 + T) / (3 + 2 * T), (0 + T) / (6 + 2 * T), 1 / 2]))
    p = s + declared + np.log(host)
    p = np.exp(p - p.max())
    got = language_id.identify(df).filter("doc_id = 8").first()
    assert got.language == languages[int(p.argmax())] and got.posterior == pytest.approx(float((p / p.sum()).max()), abs=1e-5)


def test_rare_languages_and_held_out_accuracy(spark):
    """A language of few rows among thousands keeps its class; wrong declarations and short texts are told right nearly always."""
    r = random.Random(5)
    words = {lang: sorted({"".join(r.choice(a) for _ in range(r.randint(2, 7))) for _ in range(150)}) for lang, a in (("en", "etaoinshr"), ("de", "enisratdhulßä"), ("xq", "kqzwyvjx"))}
    text = lambda lang, n: " ".join(r.choice(words[lang]) for _ in range(n))
    rows = []
    for i in range(3000):
        lang = "xq" if i % 500 == 0 else ("en", "de")[i % 2]
        said = lang if lang == "xq" or r.random() < 0.9 else ("de", "en")[i % 2]
        rows.append((i, text(lang, 25), said + ("-XX" if i % 3 == 0 else ""), f"h{i % 4}", lang))
    held = [(10000 + i, text(lang, 8), ("de", None, "en")[i % 3], "h9", lang) for i, lang in enumerate(["en", "de", "xq"] * 100)]
    df = spark.createDataFrame(rows + held, "doc_id long, text string, lang string, source string, truth string")
    got = {x.doc_id: x for x in language_id.identify(df, sample=200).collect()}
    right = lambda of: sum(got[i].language == truth for i, *_, truth in of) / len(of)
    assert right(rows) >= 0.99 and right(held) >= 0.95
    assert all(got[i].language == "xq" for i, *_, truth in rows if truth == "xq")


def test_pages_language(spark, tmp_path):
    """Text, markup language, suffix and host of pages; the suffix and the host decide where the text says nothing."""
    from lodestrata.llm.queries import pages_language

    r, rows = random.Random(2), []
    for i in range(120):
        lang = ("en", "de")[i % 2]
        body = " ".join(r.choice(TONGUES[lang].split()) for _ in range(40))
        rows.append((i, f"https://w{i % 6}.site.{('com', 'de')[i % 2]}/p{i}", f"<html lang='{lang}'><script>the the the</script><p>{body}</p></html>"))
    rows += [(500, "https://x.new.de/", "<p>0 1 2</p>"), (501, "https://y.new.com/", "<p></p>"), (502, None, None), (503, "https://w1.site.de/q", None)]
    folder = str(tmp_path / "sf")
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    got = {x.page_id: x for x in pages_language(spark, folder).collect()}
    assert len(got) == len(rows)
    assert all(got[i].language == ("en", "de")[i % 2] and got[i].declared == got[i].language and got[i].accepted for i in range(120))
    assert (got[500].language, got[501].language, got[503].language) == ("de", "en", "de") and got[500].host == "x.new.de"


def test_address_suffix(spark):
    rows = [("write to a.b@mail.example.de now", "de"), ("see http://x.y.COM/a", "com"), ("no address at all", None), (None, None), ("a@b", None), ("@" + "a." * 50000 + "org", "org")]
    got = spark.createDataFrame(rows, "t string, want string").select(language_id.address_suffix(F.col("t")).alias("got"), "want").collect()
    assert all(x.got == x.want for x in got)
