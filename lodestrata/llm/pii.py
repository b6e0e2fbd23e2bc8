"""Personal data by weak supervision.

Wide patterns propose candidate spans; labelers (shape, checksum, gazetteer, context, boundary) each vote on every
candidate: 1 personal data, 0 not, - no opinion. Expectation-maximisation over the counts of vote patterns of all rows
estimates each labeler's reliability and each pattern's probability. These are the soft labels that a logistic span
classifier is fitted to, over the votes by kind and over token and context features (form, length, the words around);
it decides on what is added to the base spans, which always stay.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import store

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("shape", "checksum", "gazetteer", "context", "boundary")
#: Least probability of an added span; EM rounds; code points on either side that the context labeler reads.
KEEP, ROUNDS, AROUND = 0.5, 100, 40
#: Candidates of each kind that the classifier is fitted on, about: those of least hash. EM counts all.
SAMPLE = 4000
#: Where EM starts: P(vote 1 | not personal), P(vote 1 | personal) of each labeler.
START = ((0.4, 0.8), (0.1, 0.95), (0.4, 0.85), (0.1, 0.8), (0.4, 0.9))

#: The base patterns. A lookbehind only skips starts that would give the same match later or none.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Wider patterns. Each is of bounded length but for runs that no other match starts in.
SPOKEN_MARK = re.compile(r" ?[\[({]at[\])}] ?| at ", re.I)
SPOKEN_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:(?: ?[\[({]dot[\])}] ?| dot |\.)[A-Za-z0-9-]+)+", re.I)
SPOKEN_DOT = re.compile(r"[\[({]dot[\])}]| dot |\.", re.I)
DEFANGED = re.compile(r"(?<![0-9])[0-9]{1,3}(?:[\[({](?:\.|dot)[\])}][0-9]{1,3}){3}(?![0-9])", re.I)
DOTTED_CARD = re.compile(r"(?<![0-9.])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])")
LOCAL_PHONE = re.compile(r"(?<![0-9+])(?:\([0-9]{3}\)[\x20.-]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
TRUNK_PHONE = re.compile(r"(?<![0-9+])(?:00[1-9][0-9]{0,2}|0[1-9][0-9]{1,4})[\x20/-][0-9](?:[\x20-]?[0-9]){5,10}(?![0-9])")
#: Gazetteers. Top-level domains of more than two letters (those of two are countries'), mail providers,
#: calling codes (three-digit ones by their first two), and first digits of cards by issuer with the lengths they have.
SUFFIXES = frozenset("com org net edu gov mil int info biz name pro aero coop museum jobs mobi travel tel cat asia post app dev cloud online site store tech shop blog live news email agency company digital group media network solutions systems world example".split())
PROVIDERS = frozenset("gmail googlemail yahoo ymail hotmail outlook live msn icloud me aol gmx web t-online protonmail proton mail inbox yandex qq 163 126 naver orange free laposte libero virgilio".split())
CALLING = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
CALLING_THREE = frozenset("21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 80 85 87 88 96 97 99".split())
ISSUERS = (("4", (13, 16, 19)), ("5[1-5]|222[1-9]|22[3-9]|2[3-6]|27[01]|2720", (16,)), ("3[47]", (15,)), ("6011|64[4-9]|65", (16, 19)), ("35(2[89]|[3-8])", (16, 19)), ("30[0-5]|36|38|39", (14, 16, 19)), ("62", (16, 17, 18, 19)))
TOLL_FREE = frozenset("800 833 844 855 866 877 888 900 411 911 211 311".split())
#: Words of the context labeler in four languages.
NEAR = {
    "email": ("mail", "contact", "write to", "reach", "address", "kontakt", "adresse", "schreib", "correo", "courriel", "écri", "contacto", "send"),
    "ip": ("ip ", "ip:", "ip-", "address", "host", "server", "login", "logged", "client", "connect", "adresse", "dirección"),
    "card": ("card", "visa", "master", "amex", "credit", "debit", "payment", "paid", "pay ", "karte", "carte", "tarjeta", "zahlung", "paiement", "pago"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "cell", "contact", "dial", "ring", "sms", "text me", "anruf", "handy", "appel", "llam", "móvil"),
}
AGAINST = ("version", "isbn", "issn", "order no", "order #", "serial", "token", "sha", "hash", "section", "part no", "invoice", "ticket", "build", "doi", "patent", "bestell", "commande", "pedido", "reference")

def luhn(digits: str) -> bool:
    odd, even = digits[::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the address pattern, found from each @ outwards, so that long words cost no more than their length."""
    done, p = 0, text.find("@")
    while p >= 0:
        start = p
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < p and (m := DOMAIN.match(text, p + 1)):
            yield start, m.end()
            done = m.end()
        p = text.find("@", max(p + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed and then start; failing matches are dropped and not retried."""
    out = [("email", s, e) for s, e in _emails(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def _spoken(text: str) -> Iterator[tuple[int, int]]:
    """Spelled-out addresses, found from each mark outwards: runs between marks are read once."""
    done = 0
    for m in SPOKEN_MARK.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start == m.start():
            continue
        d = SPOKEN_DOMAIN.match(text, m.end())
        # a bare " at " needs a spoken dot; a bracketed one any dot
        if d and (m[0].strip().lower() != "at" or " dot " in d[0].lower() or "dot" in d[0].lower() and SPOKEN_DOT.search(d[0])[0] != "."):
            yield start, d.end()
            done = d.end()
        else:
            done = m.end()


def wide_spans(text: str) -> list[tuple[str, int, int]]:
    """Candidates besides the base ones: spelled-out addresses, defanged ones, other card-like numbers, phones without a plus."""
    low = text.lower()
    out = [("email", s, e) for s, e in _spoken(text)] if any(x in low for x in ("(at", "[at", "{at", " dot ")) else []
    if any("0" <= c <= "9" for c in text):
        if any(x in low for x in ("[.", "(.", "{.", "[dot", "(dot", "{dot")):
            out += [("ip", m.start(), m.end()) for m in DEFANGED.finditer(text)]
        out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and not (len(d) >= 16 and luhn(d))]
        out += [("card", m.start(), m.end()) for m in DOTTED_CARD.finditer(text)]
        phones = sorted({(m.start(), m.end()) for p in (LOCAL_PHONE, TRUNK_PHONE) for m in p.finditer(text)})
        out += [("phone", s, e) for k, (s, e) in enumerate(phones) if not k or s >= phones[k - 1][1]]
    return out


def free_of(spans: list[tuple[str, int, int]], taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The spans that overlap none that is taken and none before them in the list's order by place; by search in merged places."""
    merged: list[list[int]] = []
    for s, e in sorted((s, e) for _, s, e in taken):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    starts, out, last = [s for s, _ in merged], [], -1
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2], x[0])):
        k = bisect_left(starts, e)
        if (not k or merged[k - 1][1] <= s) and s >= last:
            out.append((kind, s, e))
            last = e
    return out


def _phone_rules(span: str, digits: str) -> tuple[str, str]:
    """(checksum, gazetteer): the plan's rules for the digits, and whether the code is a known one."""
    if span[0] == "+" or digits.startswith("00"):
        d = digits[2:] if span[0] != "+" else digits
        known = d[:1] in CALLING or d[:2] in CALLING or d[:2] in CALLING_THREE
        rest = d[1:] if d[:1] in ("1", "7") else d[2:]
        return str(int(6 <= len(rest) <= 13 and (d[:1] != "1" or len(rest) == 10 and rest[0] in "23456789"))), str(int(known))
    if digits.startswith("0"):
        return str(int(8 <= len(digits) <= 13)), "-"
    return str(int(len(digits) == 10 and digits[0] in "23456789" and digits[3] in "23456789")), "0" if digits[:3] in TOLL_FREE else "1"


def votes(text: str, kind: str, start: int, end: int) -> str:
    """One character per labeler."""
    span, around = text[start:end], f"{text[max(0, start - AROUND) : start]} {text[end : end + AROUND]}".lower()
    digits = _digits(span)
    if kind == "email":
        plain = re.split(r"@| ?[\[({]at[\])}] ?| at ", span, maxsplit=1, flags=re.I)
        local, domain = (plain[0], re.split(r" ?[\[({]dot[\])}] ?| dot |\.", plain[-1], flags=re.I)) if len(plain) == 2 else (span, [""])
        shape = len(domain) >= 2 and domain[-1].isalpha() and len(domain[-1]) >= 2
        checksum = str(int(0 < len(local) <= 64 and local[0] not in ".-%" and local[-1] != "." and ".." not in local))
        known = str(int(domain[-1].lower() in SUFFIXES or len(domain[-1]) == 2 and domain[-1].isalpha() or domain[0].lower() in PROVIDERS))
    elif kind == "ip":
        parts = re.findall("[0-9]+", span)
        shape = all(p == "0" or p[0] != "0" for p in parts)
        small = [int(p[-4:]) for p in parts]
        checksum = str(int(len(parts) == 4 and all(n <= 255 for n in small)))
        known = str(int(0 < small[0] < 224 and small[0] != 127))
    elif kind == "card":
        groups = [len(g) for g in re.findall("[0-9]+", span)]
        shape = len(groups) == 1 or groups[0] == 4 and (set(groups[:-1]) == {4} or groups[1:2] == [6]) and len(set(re.findall("[^0-9]", span))) == 1
        checksum = str(int(luhn(digits)))
        known = str(int(any(re.match(p, digits) and len(digits) in n for p, n in ISSUERS)))
    else:
        shape = span[0] in "+(0" or len(set(re.findall("[^0-9]", span))) == 1
        checksum, known = _phone_rules(span, digits)
    context = "0" if any(w in around for w in AGAINST) else "1" if any(w in around for w in NEAR[kind]) else "-"
    edge = (text[start - 1 : start] + text[end : end + 1]) if start else text[end : end + 1]
    inside = any(c.isalnum() or c in "_=\"'/#" for c in edge)
    return f"{int(bool(shape))}{checksum}{known}{context}{int(not inside)}"


#: Features of the classifier: a constant, votes by kind, form buckets, length buckets, and the words before and after.
_FORMS, _LENGTHS, _WORDS = 64, 8, 128
_AT = {"votes": 1, "form": 1 + len(KINDS) * len(LABELERS) * 3}
_AT |= {"length": _AT["form"] + _FORMS, "before": _AT["form"] + _FORMS + _LENGTHS}
_AT |= {"after": _AT["before"] + _WORDS}
FEATURES = _AT["after"] + _WORDS


def features(text: str, kind: str, start: int, end: int, vote: str) -> list[int]:
    """Numbers of the features that a candidate has."""
    span, k = text[start:end], KINDS.index(kind)
    form = re.sub(r"[a-z]+", "a", re.sub(r"[0-9]", "9", span[:40].lower()))
    bucket = lambda x, n: zlib.crc32(f"{kind}:{x}".encode("utf-8", "replace")) % n
    words = lambda t: re.findall(r"[^\W\d_]+", t)
    before, after = words(text[max(0, start - AROUND) : start])[-2:], words(text[end : end + AROUND])[:1]
    out = [0, *(_AT["votes"] + (k * len(LABELERS) + j) * 3 + "01-".index(v) for j, v in enumerate(vote))]
    out += [_AT["form"] + bucket(form, _FORMS), _AT["length"] + min(_LENGTHS - 1, len(span).bit_length())]
    return out + [_AT["before"] + bucket(w.lower(), _WORDS) for w in before] + [_AT["after"] + bucket(w.lower(), _WORDS) for w in after]


def spans_of(text: str | None) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) of base and added candidates, by kind as listed and then start."""
    if not text or not re.search(r"[0-9@]|[\[({]at[\])}]| dot ", text, re.I):
        return []
    base = base_spans(text)
    spans = [(*x, True) for x in base] + [(*x, False) for x in free_of(wide_spans(text), base)]
    return sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1]))


def candidates(text: Column) -> Column:
    """array<struct<kind, start, end, base, votes, features>> by kind as listed and then start; null and empty texts have none."""

    @F.pandas_udf("array<struct<kind:string,start:int,end:int,base:boolean,votes:string,features:array<int>>>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for t in texts:
                out.append([])
                for k, s, e, b in spans_of(t):
                    v = votes(t, k, s, e)
                    out[-1].append({"kind": k, "start": s, "end": e, "base": b, "votes": v, "features": features(t, k, s, e, v)})
            yield pd.Series(out)

    return found(text)


def reliabilities(patterns: list[tuple[str, str, int]]) -> tuple[dict[tuple[str, str], float], np.ndarray]:
    """EM over (kind, votes, count): probability of each pattern, and by kind and labeler P(vote 1 | not), P(vote 1 | personal).

    Votes count as independent given the truth. Rates start at START; small pseudo-counts keep them off 0 and 1.
    """
    if not patterns:
        return {}, np.zeros((0, len(LABELERS), 2))
    kinds = sorted({k for k, _, _ in patterns})
    n = np.array([c for *_, c in patterns], dtype=float)
    n = n / n.sum() * 1000  # the same proportions give the same result at every size
    v = np.array([[-1 if x == "-" else int(x) for x in votes] for _, votes, _ in patterns])
    of = np.array([kinds.index(k) for k, _, _ in patterns])
    start = np.array(START)
    rate = np.tile(start, (len(kinds), 1, 1))
    prior = np.full(len(kinds), 0.5)
    p = np.full(len(n), 0.5)
    for _ in range(ROUNDS):
        log = np.stack([np.log(1 - prior)[of], np.log(prior)[of]], axis=1)
        for j in range(len(LABELERS)):
            for vote in (0, 1):
                said = v[:, j] == vote
                log[said] += np.log(rate[of[said], j] if vote else 1 - rate[of[said], j])
        p = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
        for k in range(len(kinds)):
            mine = of == k
            for j in range(len(LABELERS)):
                said, yes = mine & (v[:, j] >= 0), mine & (v[:, j] == 1)
                for c, w in enumerate((n * (1 - p), n * p)):
                    rate[k, j, c] = (w[yes].sum() + 5 * start[j, c]) / (w[said].sum() + 5)
            prior[k] = ((n * p)[mine].sum() + 1) / (n[mine].sum() + 2)
    return {(k, votes): float(x) for (k, votes, _), x in zip(patterns, p, strict=True)}, rate


def span_classifier(rows: list[tuple[list[int], float]], ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression on the features, fitted to the soft labels."""
    x = np.zeros((len(rows), FEATURES))
    for i, (at, _) in enumerate(rows):
        x[i, at] = 1
    y, w = np.array([p for _, p in rows]), np.zeros(FEATURES)
    for _ in range(15):  # Newton's steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(FEATURES)
        w += np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


def _fitted(at: DataFrame) -> np.ndarray | None:
    """The classifier's weights; None without candidates. The driver sees counts of vote patterns and the bounded sample."""
    each = at.select("id", F.explode("c").alias("c")).select("c.kind", "c.votes", "c.features", F.xxhash64("id", "c.kind", "c.start", "c.end").alias("h"))
    patterns = [(r["kind"], r["votes"], r["n"]) for r in each.groupBy("kind", "votes").agg(F.count("*").alias("n")).orderBy("kind", "votes").collect()]
    if not patterns:
        return None
    soft, _ = reliabilities(patterns)
    total = {k: sum(n for x, _, n in patterns if x == k) for k in KINDS}
    most = F.lit(0).cast("long")
    for k, n in total.items():
        if n:
            most = F.when(F.col("kind") == k, F.lit(min(2**63 - 1, int((min(1.0, SAMPLE / n) - 0.5) * 2**64)))).otherwise(most)
    rows = each.filter(F.col("h") <= most).orderBy("h", "kind", "votes").limit(2 * SAMPLE * len(KINDS)).collect()
    return span_classifier([(list(r["features"]), soft[r["kind"], r["votes"]]) for r in rows])


def find_personal_data(df: DataFrame, id: str = "doc_id", text: str = "text", keep: float = KEEP) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, found), one row per row of df.

    The counts and the digest are of the base spans (kind:start:end, comma-joined, by kind as listed and then start);
    spans and found (an array of structs) hold all, added ones too. Null and empty texts have none, and the digest of
    the empty string. EM sees the counts of vote patterns over all rows, at most 4 x 3^5 of them; the classifier is
    fitted on about SAMPLE candidates a kind and decides on all. Rows, repeated ones too, keep their number. Time is in
    proportion to a text's length, whatever stands in it.
    """
    at = store(df.select(F.col(id).alias("id"), candidates(F.col(text)).alias("c")), "span-candidates")
    w = _fitted(at)
    good = lambda c: c["base"]
    if w is not None:
        weights, least = F.lit([round(float(x), 9) for x in w]), float(np.log(keep / (1 - keep)))
        good = lambda c: c["base"] | (F.aggregate(c["features"], F.lit(0.0), lambda s, k: s + F.get(weights, k)) >= least)
    text_of = lambda a: F.array_join(F.transform(a, lambda c: F.concat_ws(":", c["kind"], c["start"].cast("string"), c["end"].cast("string"))), ",")
    at = at.withColumn("found", F.filter("c", good))
    base = F.filter("c", lambda c: c["base"])
    kinds = F.transform(base, lambda c: c["kind"])
    return at.select(
        F.col("id").alias(id),
        *((F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(text_of(base), 256).alias("base_sha256"),
        text_of(F.col("found")).alias("spans"),
        F.transform("found", lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))).alias("found"),
    )
