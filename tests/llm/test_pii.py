import hashlib
import math
import random
import re
import time

from pyspark.sql import functions as F

from lattiq.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else 0, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_against_plain_patterns(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()}
    rows = pii.op5_pii(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = brute(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, *_ in want) for x in pii.KINDS]
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(r.spans.split(",")) | {""}


ODD = [
    None, "", "é😀 a@b.c_d@e.f x@y.z.", "1.2.3.4.5.6.7.8 999.1.1.1 001.002.003.255 1.2.3", "4111 1111-1111 1111 4111111111111112 0000-0000-0000-0", "+1 (543) 555-9258 +12 +1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6 ++49 30 1234567",
    "a" * 50_000, "1" * 50_000, "1." * 20_000, "a@" + "b." * 20_000 + "c", "+1" + "()" * 20_000, "a.b@c" * 3000,
]


def test_odd_texts(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(None, "a@b.c", "x"), (3, ODD[3], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base string")
    got = pii.find_pii(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        text = ODD[r.doc_id] if r.doc_id is not None else "a@b.c"
        assert [(b.kind, b.s, b.e) for b in r.base] == brute(text), text and text[:60]
    assert pii.find_pii(docs.limit(0)).count() == 0


def test_many_identifiers_in_one_text(spark):
    """Offsets go on over runs; a hundred thousand identifiers in one text are found in seconds."""
    few = " ".join(f"é w{i} a{i}@b.c 10.0.0.{i % 300} card {i}" for i in range(1300))
    many = " ".join(f"id{i}" for i in range(100_000))
    docs = spark.createDataFrame([(1, few), (2, many)], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in pii.base_spans(docs).collect()}
    assert time.time() - began < 60
    assert [(b.kind, b.s, b.e) for b in got[1].base] == brute(few) and not got[2].base
    assert [(m.s, m.e, m.x) for m in got[2].words] == [(m.start(), m.end(), m.group()) for m in re.finditer(r"\S+", many)]


def test_what_stands_before(spark):
    df = spark.createDataFrame([("one two 11 three 22 33",), ("x " * 3000 + "last 9",)], "t string")
    got = [[(m.x, m.left) for m in r[0]] for r in df.select(pii._spans(F.col("t"), "[0-9]++").alias("m")).collect()]
    assert got[0] == [("11", "one two "), ("22", "one two 11 three "), ("33", "one two 11 three 22 ")]
    assert got[1] == [("9", ("x " * 3000 + "last ")[-80:])]
    text = " ".join(str(i) for i in range(2000))
    (row,) = spark.createDataFrame([(text,)], "t string").select(pii._spans(F.col("t"), "[0-9]++").alias("m")).collect()
    assert [(m.s, m.e, m.left) for m in row[0]] == [(m.start(), m.end(), text[max(0, m.start() - 80) : m.start()]) for m in re.finditer("[0-9]+", text)]


def brute_patterns(words, rounds=pii.ROUNDS):
    """{pattern: kind} of the trusted ones of [(pattern, x, kind or None)]."""
    edges = {}
    for c, x, k in words:
        edges[c, x] = min((v for v in (edges.get((c, x)), k) if v), default=None)
    trusted = {}
    for _ in range(rounds):
        found = {}
        for (c, x), k in edges.items():
            if k is None and c in trusted and re.search(pii._LIKE[trusted[c]], x):
                found[x] = min(found.get(x, "~"), trusted[c])
        by = {}
        for (c, x), k in edges.items():
            by.setdefault(c, []).append(k or found.get(x))
        trusted = {}
        for c, kinds in by.items():
            best = max(((kinds.count(k) / len(kinds) * math.log2(kinds.count(k)), k) for k in pii.SPAN_KINDS if kinds.count(k) >= pii.LEAST_KNOWN and kinds.count(k) >= pii.LEAST_SHARE * len(kinds)), default=None)
            if best:
                trusted[c] = best[1]
    return trusted


def test_patterns_against_brute_force(spark):
    rng = random.Random(2)
    words = []
    for _ in range(600):
        kind = rng.choice(["card", "phone", "secret", None])
        x = {"card": "4" * 12 + str(rng.randrange(10**4)).zfill(4), "phone": f"+49 30 {rng.randrange(10**6, 10**7)}", "secret": f"{rng.getrandbits(160):040x}", None: f"n{rng.randrange(50)}"}[kind]
        words.append((f"{kind or rng.choice(['card', 'phone', 'no'])}{rng.randrange(12)} is", x, kind if rng.random() < 0.6 else None))
    df = spark.createDataFrame([{"ctx": c, "x": x, "kind": k} for c, x, k in words], "ctx string, x string, kind string").groupBy("ctx", "x").agg(F.min("kind").alias("kind"))
    assert {r.ctx: r.kind for r in pii.trusted_patterns(df).collect()} == brute_patterns(words)


def test_masked_seeds_are_found_again(spark):
    """Of the identifiers of each kind, half lose the form that proves them; their patterns find them, and nothing in clean texts."""
    rng = random.Random(4)
    valid = [c for c in (str(rng.randrange(10**15, 10**16)) for _ in range(2000)) if luhn(c)]
    invalid = [c for c in (str(rng.randrange(10**15, 10**16)) for _ in range(200)) if not luhn(c)]
    rows, masked = [], {}
    for i in range(40):
        hidden = i % 2 == 1
        parts = {
            "card": ("please charge card number ", (invalid if hidden else valid)[i]),
            "phone": ("or call us at ", f"0{rng.randrange(10, 99)} {rng.randrange(10**6, 10**7)}" if hidden else f"+49 30 {rng.randrange(10**6, 10**7)}"),
            "secret": ('with token = "', (f"{rng.getrandbits(90):x}zz" if hidden else f"{rng.getrandbits(160):040x}") + '"'),
        }
        text = ""
        for kind, (before, x) in parts.items():
            text += f" w{chr(97 + rng.randrange(26))}{before}"
            if hidden:
                x = x.strip('"')
                masked[i, kind] = (len(text), len(text) + len(x))
            text += x
        rows.append((i, text))
    rows += [(100 + i, f"page {i} of {i * 7} in version 2.{i} and 1234567 more") for i in range(30)]
    got = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hit = [(a.s, a.e) in {(x.s, x.e) for x in got[i].added if x.kind == kind} for (i, kind), a in ((k, type("S", (), {"s": v[0], "e": v[1]})) for k, v in masked.items())]
    print("masked seeds found", sum(hit) / len(hit))
    assert sum(hit) / len(hit) >= 0.9 and not any(got[100 + i].added for i in range(30))


def test_secrets_of_the_table(spark):
    rows = pii.op5_pii(spark, "/root/testdata/sf0.01").collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()}
    want = {i: len(re.findall(r'(?i)token = "[0-9a-f]{40}"', t)) for i, t in docs.items()}
    assert sum(want.values()) and {r.doc_id: r.n_secret for r in rows} == want


def test_patterns_discover_identifiers(spark):
    """Numbers that fail the check are found after words that stand before cards; the same numbers elsewhere are not."""
    cards = ["4111111111111111", "5500005555555559", "4012888888881881", "6011111111111117"]
    rows = [(i, f"the order was paid by card number {c} on friday") for i, c in enumerate(cards)]
    rows += [(10, "again by Card  number 4111111111111112."), (11, "part serial 4111111111111112 in stock"), (12, "card number pending 77"), (13, "the card number x1")]
    got = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(a.kind, a.x) for a in got[10].added] == [("card", "4111111111111112")]
    assert all(not got[i].added for i in got if i != 10) and all(len(got[i].base) == 1 for i in range(4))
