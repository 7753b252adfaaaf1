"""The other operators against plain Python on small fixtures."""

from __future__ import annotations

import gzip
import hashlib
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import decontamination, html_text, language, mixing, pii, quality, secrets, sharding, warc
from tests.llm.conftest import WORD


# -- 1 quality
def counts(text):
    w = WORD.findall(text or "")
    tri = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + d for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for d in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


@pytest.fixture(scope="module")
def labels(spark, corpus):
    return corpus.where("doc_id % 2 = 0").select("doc_id", F.when(F.col("doc_id") % 6 == 0, 0).otherwise(1).alias("quality"), F.lit(0).alias("toxic"))


def test_quality_counts(spark, corpus, labels):
    more = spark.createDataFrame([(9001, "a#b c d\na#b c d\n\n  \n x x x x x x"), (9002, "q w e r q w e r q w e"), (9003, "l\n\tl\nl\n")], "doc_id long, text string")
    docs = corpus.select("doc_id", "text").unionByName(more)
    text = {i: r["text"] for i, r in enumerate(docs.collect())}
    got = quality.quality(docs, labels).collect()
    want = Counter((counts(t)) for t in text.values())
    assert Counter((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def xx(*values):
    """Spark's xxhash64 of strings and longs."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True), h)
    return h - (1 << 64) if h >> 63 else h


def quality_by_hand(text, trusted):
    """Weights, threshold, scores and verdicts of rows {row: text}; trusted: {row: bool} of the labelled ones."""

    def buckets(t):
        h = [xx(w) for w in WORD.findall(t or "")]
        return [x % quality.BUCKETS for x in h] + [xx(a, b) % quality.BUCKETS for a, b in zip(h, h[1:], strict=False)]

    grams = {i: buckets(t) for i, t in text.items()}
    raw, good = Counter(), Counter()
    for i, g in grams.items():
        raw.update(g)
        if trusted.get(i):
            good.update(g)
    share = lambda n, b: (n[b] + 1) / (n.total() + quality.BUCKETS)
    weight = [np.log(share(good, b)) - np.log(share(raw, b)) for b in range(quality.BUCKETS)]
    score = {i: np.mean([weight[b] for b in g]) if g else None for i, g in grams.items()}
    failed = {i: (c := counts(t))[0] < 50 or 100 * c[4] > 50 * c[0] for i, t in text.items()}
    of = lambda kind: [score[i] for i, k in trusted.items() if k is kind and i in score and not failed[i]]
    if of(False):
        low, high = np.percentile(of(True), 0.5), np.percentile(of(False), 95)
        threshold = min(high + (low - high) / 4, low)
    else:
        threshold = min(of(True))
    kept = {i: not failed[i] and score[i] is not None and score[i] >= threshold - 1e-9 for i in text}
    return weight, threshold, score, failed, kept


def test_quality_model_matches_brute_force(spark, corpus, labels):
    """Buckets, multinomials, threshold, scores and verdicts, all recomputed in Python."""
    docs = corpus.where("doc_id is not null").dropDuplicates(["doc_id"])
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    trusted = {r["doc_id"]: r["quality"] == 1 for r in labels.where("doc_id is not null").collect()}
    weight, threshold, score, failed, _ = quality_by_hand(text, trusted)
    weights, got = quality.llr_model(docs, quality.trusted_sample(labels))
    assert got == pytest.approx(threshold, abs=1e-5) and np.allclose(weights, weight, atol=1e-6)
    for r in quality.quality(docs, labels).collect():
        i = r["doc_id"]
        assert r["base_failed"] == failed[i] and (r["score"] is None) == (score[i] is None)
        if score[i] is not None:
            assert r["score"] == pytest.approx(score[i], abs=1e-5)
            if abs(score[i] - threshold) > 1e-5:
                assert r["kept"] == (not failed[i] and score[i] >= threshold)


def test_quality_uses_every_label(spark, monkeypatch):
    """Model and threshold come from all of 24 000 labelled documents, whichever way labels are joined, and whatever kind of id."""
    rng = random.Random(3)
    text = {i - 500: " ".join(f"{'junk' if i % 7 == 0 and rng.random() < 0.5 else 'w'}{int(rng.expovariate(0.01))}" for _ in range(50 + i % 3)) for i in range(24_000)}
    docs = spark.createDataFrame(list(text.items()), "doc_id long, text string").repartition(4)
    labels = docs.select("doc_id", F.when(F.pmod("doc_id", F.lit(7)) == (-500) % 7, 0).otherwise(1).alias("quality"), F.lit(0).alias("toxic"))
    weight, threshold, _, _, kept = quality_by_hand(text, {i: (i + 500) % 7 != 0 for i in text})
    assert quality.trusted_sample(labels).count() == len(text)
    named = lambda df: df.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    for d, lab, blocks in ((docs, labels, quality.BLOCKS), (docs, labels, 0), (named(docs), named(labels), quality.BLOCKS), (docs.withColumn("doc_id", F.col("doc_id").cast("int")), labels, 0)):
        monkeypatch.setattr(quality, "BLOCKS", blocks)
        weights, got = quality.llr_model(d, quality.trusted_sample(lab))
        assert np.allclose(weights, weight, atol=1e-6) and got == pytest.approx(threshold, abs=1e-5)
    assert 0 < sum(kept.values()) < len(text)


def test_quality_percentiles(spark):
    """Exact, as F.percentile has them, also with many ties and groups of one."""
    rng = random.Random(4)
    rows = [(True, rng.choice([-0.5, rng.random()])) for _ in range(3001)] + [(False, 0.25)]
    df = spark.createDataFrame(rows, "trusted boolean, score double").repartition(3)
    shares = [0.0, 0.005, 0.37, 0.95, 1.0]
    want = {r["trusted"]: r["p"] for r in df.groupBy("trusted").agg(F.percentile("score", F.array(*map(F.lit, shares))).alias("p")).collect()}
    got = quality._percentiles(df, shares)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    assert quality._percentiles(df.limit(0), shares) == {}


def test_quality_separates(spark):
    good = [(i, " ".join(f"clean{(i * 7 + j * 3) % 40}" for j in range(80))) for i in range(40)]
    bad = [(100 + i, " ".join(f"junk{(i * 5 + j * 7) % 60}***" for j in range(80))) for i in range(20)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    lab = spark.createDataFrame([(i, 1, 0) for i in range(0, 40, 2)] + [(100 + i, 0, 0) for i in range(0, 20, 2)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"]: (r["kept"], r["base_failed"]) for r in quality.quality(docs, lab).collect()}
    assert all(not k for d, (k, _) in kept.items() if d >= 100)
    assert all(k or f for d, (k, f) in kept.items() if d < 100)


def test_quality_without_labels(corpus, labels, nothing):
    assert quality.quality(nothing, labels).count() == 0
    assert quality.keep_good(corpus, labels.limit(0)).columns == corpus.columns


@pytest.mark.parametrize("spare", [0, 44])
def test_quality_long_texts(spark, spare):
    """Windows are told apart and repeats among them found, also where their bits are few."""
    from tessera.llm.common import words

    far = " ".join(f"w{i}" for i in range(200_000 if not spare else 20_000))
    texts = {1: (far, 0), 2: (far + " w7 w8 w9 w10 zz", 8), 3: ("a b c " + " ".join(f"w{i}" for i in range(300)) + " a b c", 6), 4: ("a b", 0), 5: ("a b a b a b", 6)}
    docs = spark.createDataFrame([(i, t) for i, (t, _) in texts.items()], "doc_id long, text string")
    got = docs.select("doc_id", quality.let(words(F.col("text")), lambda w: quality.let(quality._hashes(w), lambda h: quality._repeated(h, spare))).alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in got} == {i: n for i, (_, n) in texts.items()}


# -- 2 personal data
PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]
PII_TEXTS = [
    None, "", "mail a.b@c.de, x@y and q@w.e.r. a@b.c_d@e.f x@y.z.@q.w", "1.2.3.4.5.6.7.8 256.1.1.1 1.1.1.999999999999 001.002.003.0004 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112 4111 11111111 11117 5",
    "+1 (017) 555-7713 +49-30-1234567890123456 +1 2 +12345678901 +1((((((((((((2345678901", "éé 日本 a@b.cd é 1.2.3.4\n+1 (017) 555-7713", "4" * 3000 + " " + "1 " * 2000, "a" * 4000 + "@" + "b." * 500 + "c", "+1" + " " * 500, "1" * 16 + "-" + "1.1.1.1@a.b",
]


def luhn(d):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, p) in enumerate(PII):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda m=m: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda d=d: 14 <= len(d) <= 19 and luhn(d), "phone": lambda d=d: 10 <= len(d) <= 15}[kind]()
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii_base(spark, corpus):
    docs = spark.createDataFrame(list(enumerate(PII_TEXTS)), "doc_id long, text string").unionByName(corpus.select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text"))
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = pii.find_pii(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        spans = base_spans(text[r["doc_id"]]) if r["doc_id"] is not None else []
        digest = ",".join(f"{PII[k][0]}:{a}:{b}" for a, k, b in spans)
        assert r["base_sha256"] == hashlib.sha256(digest.encode()).hexdigest(), (r["doc_id"], digest, r["spans"])
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == i for _, k, _ in spans) for i in range(4)]


def test_pii_context_discovers(spark):
    """A pattern with enough seeds marks a number that no matcher accepts."""
    seeds = ["4111111111111111", "5500005555555559", "4012888888881881", "378282246310005", "6011111111111117", "3530111333300000", "5105105105105100", "4222222222222220"]
    rows = [(i, f"please charge my card {s} for the order number {i}") for i, s in enumerate(seeds)] + [(50, "please charge my card 4111111111111112 for the order"), (51, "the year 123456789 of nothing")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(docs).collect()}
    assert got[50] == "contextual:22:38"
    assert "contextual" not in got[51]


def planted_identifiers(n=300):
    """Texts with identifiers that no matcher knows, and the spans of those: (rows, {(doc, start, end)}, round that can find them)."""
    rng = random.Random(9)
    vocab = ["word%s" % chr(97 + i) * (1 + i % 2) for i in range(26)]
    noise = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card(valid):
        while True:
            d = "4" + digits(15)
            if luhn(d) == valid:
                return d

    rows, want = [], {}

    def add(before, value, after, kind):
        lead = f"{noise(rng.randrange(3, 9))} {before} "
        if kind:
            want[len(rows), len(lead), len(lead) + len(value)] = kind
        rows.append((len(rows), f"{lead}{value} {after} {noise(4)}"))

    members = [f"LM-{digits(5)}-{rng.choice('XYZ')}" for _ in range(n // 5)]
    spaced = lambda d: " ".join(d[i : i + 4] for i in range(0, 16, 4))
    for _ in range(n):
        add("please charge my card", card(True), "for it", None)
    for i in range(n // 5):
        add("please charge my card", card(False), "for it", "first")
        add("please charge my card", spaced(card(False)), "for it", "first")
        if i % 2 == 0:
            add("please charge my card", members[i], "for it", "first")
        add("loyalty member id", members[i], "since then", "second")
        add("loyalty member id", f"QX{digits(6)}", "since then", "second")
        add("please charge my card", "20240101", "for it", None)  # a number that is everywhere
    for i in range(2 * n):
        add(f"the {rng.choice(vocab)}", rng.choice(["20240101", "19991231", "31415926"]), rng.choice(vocab), None)
        add("order number", digits(8), "of ours", None)
    return rows, want


def test_pii_bootstrap_finds_planted_identifiers(spark):
    """Precision and recall over unseen identifiers; the second context meets no base entity."""
    rows, want = planted_identifiers()
    got = {(r["doc_id"], s["start"], s["end"]) for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "found").collect() for s in r["found"]}
    right = got & set(want)
    assert len(right) / len(got) >= 0.95
    for kind in ("first", "second"):
        assert sum(want[x] == kind for x in right) / sum(v == kind for v in want.values()) >= 0.95
    first = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"), rounds=1).select("found").collect()
    assert 0 < sum(len(r["found"]) for r in first) < len(got)  # later rounds need the first one's finds


def test_pii_long_text_is_linear(spark):
    """Offsets of many matches in one text, against Python."""
    text = "\ue002 \ue040 " + " ".join(f"{i % 256}.0.0.{i % 250} n{i} 1234{i}" for i in range(6000))
    (r,) = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(s["start"], s["rank"], s["end"]) for s in r["base"]] == base_spans(text)


# -- 4 secrets
def test_secret_scan(spark):
    texts = [
        'set token = "4d44c79e8bf7c55759c4958dd60ed83d2ef8cd4e" now', "the number 9807915762804490 is long", "see /docs/page/9807915762804490.html", "2024-01-02-030405060708 was a day", None, "",
        'password: "hT9x2LqPz81mNc0vB7wE4rYkJ3uS6dFa"', "thereforeneverthelesswhatever2", "é" * 30 + ' secret="9b0b3c6a43eb78aa99cbd7049c572391524f37a8"',
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in secrets.scan(docs).collect()}
    assert set(got) == {0, 6, 8}
    for i, r in got.items():
        assert texts[i][r["start"] : r["end"]] == r["value"]
    assert secrets.scan(docs.limit(0)).count() == 0


def test_secret_forest_holds_out(spark):
    """Held-out findings of every template."""
    findings = secrets.labelled_findings(spark, 4000)
    train, test = findings.where("hash(left, value, right) % 4 <> 0"), findings.where("hash(left, value, right) % 4 = 0")
    model = secrets.train(train, [])
    out = model.transform(secrets._assembled(secrets.features(test, []))).select("label", "prediction", "template").collect()
    right = {t: [r["label"] == r["prediction"] for r in out if r["template"] == t] for t in {r["template"] for r in out}}
    assert len(right) == 24 and sum(map(sum, right.values())) / len(out) > 0.97
    assert all(sum(x) / len(x) >= 0.85 for x in right.values()), {t: sum(x) / len(x) for t, x in right.items()}


def test_secret_planted(spark):
    """Precision and recall over texts with planted secrets, and edge cases of a table."""
    rng = random.Random(3)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    words = lambda n: " ".join(rng.choice(["the", "value", "of", "this", "long", "note", "stands", "alone"]) for _ in range(n))
    key = lambda what: f"-----BEGIN {what}-----\n{hexes(64)}\n{hexes(64)}\n-----END {what}-----"
    rows, want = [], set()
    for i in range(300):
        secret = [hexes(40), "AKIA" + (hexes(16).upper() if i % 2 else "QWERTYUIOPASDFGH"), "ghp_" + hexes(36), hexes(64), key("RSA PRIVATE KEY")][i % 5]
        lead = words(9) + (' token = "' if i % 5 not in (1, 4) else "\n")
        want.add((i, len(lead), len(lead) + len(secret)))
        rows.append((i, f"{lead}{secret}\" {words(5)}", "x"))
    plain = [lambda: f"see /{words(1)}/{hexes(32)}.html", lambda: key("CERTIFICATE"), lambda: f"on 2024-01-02-{rng.randrange(10**12)}", lambda: f"number {rng.randrange(10**16, 10**17)}", lambda: "password: " + words(1), lambda: "the-long-name-of-a-thing-12"]
    rows += [(1000 + i, f"{words(6)} {plain[i % 6]()} {words(6)}", "x") for i in range(300)]
    rows += [(0, rows[0][1], "y"), (None, None, "x"), (2000, "", "x"), (2001, words(200_000), "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, value string").withColumns({"score": F.lit(1), "left": F.lit("a")})
    found = [(r["doc_id"], r["start"], r["end"]) for r in secrets.scan(docs).collect()]
    assert Counter(found)[next(x for x in want if x[0] == 0)] == 2  # the repeated row
    assert len(set(found) & want) / len(want) >= 0.95 and len(set(found) & want) / len(set(found)) >= 0.95


def test_secret_dictionary_counts_every_document(spark):
    """Beyond any sample: each of 6000 documents has a word of its own."""
    name = F.translate(F.format_string("%04d", F.col("id").cast("int")), "0123456789", "abcdefghij")
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("common "), name).alias("text"))
    known = secrets.dictionary(docs, size=10_000)
    assert known[0] == "common" and len(known) == 6001


def test_secret_assignments_are_split(spark):
    """The value alone is reported, and a name that tells admits short and digit-free ones."""
    key = "4d44c79e8bf7c55759c4958dd60ed83d2ef8cd4e"
    texts = {
        0: (f"set API_KEY={key} now", key), 1: (f"go to http://h.x/a?token={key}&x=1", key), 2: ("my password: hT9x2LqP here", "hT9x2LqP"),
        3: ("secret=hTQxrLqPzUmNcXvBbwEkrYkJ", "hTQxrLqPzUmNcXvBbwEkrYkJ"), 4: ("see aGVsbG8gd29ybGQgMTIzNDU2Nw== there", "aGVsbG8gd29ybGQgMTIzNDU2Nw=="), 5: ("nothing short: ab12cd", None),
    }
    docs = spark.createDataFrame([(i, t) for i, (t, _) in texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: r for r in secrets.candidates(docs).collect()}
    assert {i: r["value"] for i, r in got.items()} == {i: v for i, (_, v) in texts.items() if v}
    assert all(texts[i][0][r["start"] : r["end"]] == r["value"] for i, r in got.items())
    f = {r["doc_id"]: r for r in secrets.features(secrets.candidates(docs), []).collect()}
    assert all(f[i]["assigned"] == f[i]["keyword"] == 1 for i in (0, 1, 2, 3)) and f[0]["hex"] == 1
    assert {r["doc_id"] for r in secrets.scan(docs).collect()} >= {0, 2, 3}
    long = spark.createDataFrame([("a" * 600 + "b" * 600, "", "")], "value string, left string, right string")
    assert secrets.features(long, []).first()["entropy"] == pytest.approx(1.0)


# -- 5 decontamination
def test_decontamination_matches_brute_force(spark, corpus, sets):
    long = next(r["text"] for r in corpus.where("length(text) > 100000").collect())
    w = long.split()
    items = [" ".join(w[k : k + n]) for k, n in ((5, 6), (100, 9), (2000, 16), (29_900, 40), (700, 64), (9000, 300), (29_990, 5), (3, 3), (1, 1))]
    for k in range(60):  # partly changed: containments on both sides of the threshold
        x = w[k * 90 : k * 90 + 10 + k]
        for j in range(0, len(x), 14 - k % 10):
            x[j] = "zz"
        items.append(" ".join(x))
    rows = list(enumerate(items)) + [(900, None), (901, ""), (902, "a b c"), (None, "w1 w2"), (903, items[0]), (5, "w1 w2 w3 w4 w5 w6")]
    bench = spark.createDataFrame(rows, "item_id long, text string")
    want = set()
    for r in corpus.collect():
        own = sets(r["text"])
        for i, t in rows:
            q = sets(t)
            if i is not None and q and len(q & own) >= 0.8 * len(q):
                want.add((r["doc_id"], i, len(q), len(q & own)))
    for block in (1 << 20, 3000):
        got = decontamination.contaminated(corpus, bench, block=block)
        assert {(r["doc_id"], r["item_id"], r["n_item"], r["n_shared"]) for r in got.collect()} == want
    assert len(list(decontamination._blocks(bench.where("item_id is not null"), 3000, 0.8))) > 2
    kept = decontamination.drop_contaminated(corpus, bench.where("item_id is not null"), block=3000)
    assert kept.columns == corpus.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in corpus.collect()} - ({d for d, *_ in want} - {None})
    assert decontamination.contaminated(corpus.limit(0), bench).count() == 0
    assert decontamination.contaminated(corpus, bench.limit(0)).count() == 0


# -- 6 language
def test_language(spark):
    words = {"aa": ["banana", "kala", "naba", "sala"], "bb": ["grzt", "wrlk", "brrk", "trsk"], "cc": ["ühö", "öüß", "äöl", "ßäü"]}
    rows = [(i, " ".join(words[k][(i * 3 + j * 7) % 4] for j in range(60)), k) for i, k in enumerate(["aa", "bb", "cc"] * 30)]
    rows += [(1000, None, "aa"), (1001, "123 ... !!", None), (1002, "", "bb"), (1003, "日本", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(docs.where(~language.held_out(F.col("doc_id"))))
    got = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    assert all(got[i]["lang_pred"] == k for i, _, k in rows[:90])
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3
    assert got[1003]["lang_pred"] in words
    mixed = spark.createDataFrame([(1, rows[0][1] + " " + rows[0][1] + " " + rows[1][1], None)], "doc_id long, text string, lang string")
    r = language.identify(mixed, model).first()
    assert set(r["languages"]) == {"aa", "bb"} and r["lang_pred"] == "aa" and 0.5 < r["score"] < 0.85
    assert language.identify(docs.limit(0), model).count() == 0
    assert language.identify(docs, language.learn(docs.limit(0))).where("lang_pred <> 'und'").count() == 0


def test_language_matches_brute_force(spark, corpus):
    """Trigrams, probabilities, mixtures and the choice of languages, one by one in Python."""
    sentence = {"en": "the cat sat on the mat and the dog lay by the door ", "fr": "le chat est sur le tapis et le chien est à la porte ", "de": "die Katze saß auf der Matte und der Hund lag vor der Tür "}
    rows = [(i, sentence[k] * (1 + i % 3), k) for i, k in enumerate(["en", "fr", "de"] * 12)]
    rows += [(100 + i, sentence[a] * 4 + sentence[b] * (i + 1), None) for i, (a, b) in enumerate([("en", "fr"), ("fr", "de"), ("de", "en"), ("en", "de")])]
    rows += [(200, sentence["en"] * 60_000, None), (201, "½ ² 3", None), (202, "①", None), (203, "é", None)]
    docs = spark.createDataFrame([(*r, r[0]) for r in rows + rows[:5]], "doc_id long, text string, lang string, score long")
    trained = [r for r in rows + rows[:5] if r[2] is not None]

    def grams(text):
        low = [32, 32] + [(b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalpha() else 32 for b in text.encode()]
        return Counter((a << 16 | b << 8 | c) * 2654435761 % 2**32 >> 18 for a, b, c in zip(low, low[1:], low[2:], strict=False) if b != 32 or (a != 32 and c != 32))

    langs = ["de", "en", "fr"]
    total = {k: sum((grams(t) for _, t, x in trained if x == k), Counter()) for k in langs}
    p = {k: lambda b, k=k: (total[k][b] + 0.5) / (total[k].total() + 0.5 * language.BUCKETS) for k in langs}

    def em(n, own, share, rounds):
        for _ in range(rounds):
            new = dict.fromkeys(own, 0.0)
            for b, m in n.items():
                dense = sum(share[k] * p[k](b) for k in own)
                for k in own:
                    new[k] += m * share[k] * p[k](b) / dense / n.total()
            moved = max(abs(new[k] - share[k]) for k in own)
            share = new
            if moved < 1e-3:
                break
        return share, sum(m * np.log(sum(share[k] * p[k](b) for k in own)) for b, m in n.items())

    def expected(text):
        n = grams(text)
        share, _ = em(n, langs, dict.fromkeys(langs, 1 / 3), 20)
        order, best = sorted(langs, key=lambda k: (-share[k], k)), None
        for size in (1, 2, 3):
            own = order[:size]
            part, fit = em(n, own, {k: share[k] / sum(share[x] for x in own) for k in own}, 5)
            value = fit - size * 3 * np.log(max(2, n.total()))
            if best is not None and value <= best[1]:
                break
            best = part, value
        return max(best[0].items(), key=lambda x: x[1])

    model = language.learn(docs)
    got = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    for i, t, _ in rows:
        if i in (201, 202):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0)
        elif i != 200:
            lang, score = expected(t)
            assert got[i]["lang_pred"] == lang and got[i]["score"] == pytest.approx(score, abs=1e-6)
    assert got[200]["lang_pred"] == "en" and len(rows[-4][1]) > 3_000_000
    # what reaches the driver doesn't grow with the partitions
    assert len({language.bucket_counts(docs.repartition(n)).count() for n in (1, 7)}) == 1


# -- 7 html
def test_html_lines_and_text():
    page = '<html><head><title>t</title><script>var x="</p>";</script></head><body><nav>menu</nav><div class="ad">buy</div><article><h1>Head &amp; <b>bold</b></h1><p>One<br>two<p>Three &#233;<!-- no --></article><footer>f</footer></body></html>'
    assert html_text.main_text(html_text.lines_of(page), []) == "Head & bold One two Three é"
    assert html_text.main_text(html_text.lines_of(page[: page.index("<br>")]), []) == "Head & bold One"
    assert html_text.main_text(html_text.lines_of("<article><p>a &am"), []) == "a &am"
    assert html_text.main_text(html_text.lines_of("<article><p>a<p class='"), []) == "a"
    assert html_text.main_text(html_text.lines_of(""), []) == ""
    assert html_text.main_text(html_text.lines_of("<p>" * 3000 + "x"), []) == "x"


@pytest.mark.parametrize("tag", ["<svg viewBox='0'/>", "<math/>", "<noscript>", "<video src='x'>", "<canvas>", "<select>", "<svg>t<svg/>u</svg>"])
def test_html_skips_no_further_than_an_element(tag):
    page = f"<article><p>One</p>{tag}<p>Two</p></article>"
    assert html_text.main_text(html_text.lines_of(page), []) == "One Two"
    later = f"<article><p>One</p>{tag}<p>Two</p><video>no</video><svg>no</svg></article>"
    assert html_text.main_text(html_text.lines_of(later), []) == "One Two"


def test_html_keeps_formulas():
    assert html_text.main_text(html_text.lines_of("<article><p>where <math><mi>E</mi><mo>=</mo><mn>2</mn></math> holds</p></article>"), []) == "where E=2 holds"


def test_html_differencing(spark):
    page = lambda body, top="Site top line": f"<body><p>{top}</p><p>{body}</p><p>Contact us here</p></body>"
    rows = [(1, "http://h.x/a/1", page("first text of some length that is its own and goes on")), (2, "http://h.x/a/2", page("second text of some length that is its own and goes on")), (3, "http://other.x/a/1", page("alone")), (4, None, None), (5, "http://h.x/b/1", ""), (6, "http://h.x/a/1", page("first text of some length that is its own and goes on"))]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[2] == "second text of some length that is its own and goes on"
    assert got[1].startswith("Site top line") or got[1].startswith("first text")
    assert got[3] == "Site top line alone Contact us here"
    assert got[4] == got[5] == ""
    pages = spark.createDataFrame([(i, f"http://h.x/d{i % 3}/{i}", page(f"body {i} " + "some more words " * 9)) for i in range(40)], "page_id long, url string, html string")
    one, many = (sorted(tuple(r) for r in html_text.extract(pages, per_range=n).collect()) for n in (1000, 5))
    assert one == many and len(one) == 40
    assert all(t == f"body {i} " + ("some more words " * 9).strip() for i, _, t, _ in one)
    assert html_text.extract(pages.limit(0)).count() == 0


def test_html_difference_judges_beside_an_article():
    """A body in plain divs stays beside a teaser; shared lines outside the article go."""
    page = lambda k: html_text.lines_of(f"<div>Top line of the site</div><article>Teaser {k}</article><div>Long body of page {k}</div>")
    other = [[html_text.digest(x.text) for x in page(k)] for k in (2, 3)]
    assert html_text.main_text(page(1), other) == "Teaser 1 Long body of page 1"
    assert html_text.main_text(page(1), []) == "Top line of the site Teaser 1 Long body of page 1"


def test_html_large_template_is_no_copy():
    template = "".join(f"<p>A long line of the template, number {i}</p>" for i in range(9))
    page = lambda *own: html_text.lines_of(template + "".join(f"<p>{x}</p>" for x in own))
    digests = lambda lines: [html_text.digest(x.text) for x in lines]
    assert html_text.main_text(page("short a"), [digests(page("short b")), digests(page("short c"))]) == "short a"
    whole = " ".join(x.text for x in page("short a"))
    assert html_text.main_text(page("short a"), [digests(page("short a"))] * 2) == whole  # copies
    assert html_text.main_text(page("short a"), [digests(page("short b"))] * 2) == whole  # an edited copy of two equal pages
    assert html_text.main_text(page("short a"), [digests(page("short b"))]) == whole


@pytest.mark.parametrize(("a", "b", "want"), [([1, 2, 3, 4], [2, 4], {1, 3}), ([1, 1, 2], [1, 2, 1], None), ([], [1], set()), ([5], [], set())])
def test_lcs(a, b, want):
    got = html_text.shared(a, b)
    if want is not None:
        assert got == want
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    assert len(got) == best[-1][-1]


def test_lcs_in_halves(monkeypatch):
    """The divided alignment is a longest one, too."""
    rng = random.Random(8)
    for _ in range(40):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(40))] for _ in range(2))
        monkeypatch.setattr(html_text, "TABLE", 1 << 27)
        whole = html_text.shared(a, b)
        monkeypatch.setattr(html_text, "TABLE", 20)
        halves = html_text.shared(a, b)
        assert len(whole) == len(halves)
        it = iter(b)
        assert all(any(a[i] == x for x in it) for i in sorted(halves))  # a subsequence of b
    assert len(html_text.shared([i % 50_021 for i in range(60_000)], [i % 49_999 for i in range(60_000)])) > 40_000


def html_brute(rows):
    """Every page against its nearest by URL, by a plain table of lengths."""

    def lcs(a, b):
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        return t[-1, -1]

    split = lambda u: re.match(r"(?:\w+://([^/]*))?([^?#]*)", u or "").groups()
    keyed = sorted(((split(u)[0] or "").lower(), split(u)[1] or "", i, h) for i, u, h in rows)
    out = {}
    for k, (host, path, i, h) in enumerate(keyed):
        near = [keyed[j] for j in (k - 1, k + 1) if 0 <= j < len(keyed) and keyed[j][0] == host]
        near.sort(key=lambda x: -len(os.path.commonprefix([path.split("/"), x[1].split("/")])))
        own = [x.text for x in html_text.lines_of(h)]
        out[i] = own, [lcs(own, [x.text for x in html_text.lines_of(x[3])]) for x in near]
    return out


def test_html_extracts_planted_text(spark):
    """Precision and recall of words over templates, by the difference and by markup."""
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(500)]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    rows, want, menus = [], {}, {h: [line(3) for _ in range(6)] for h in range(5)}
    for i in range(200):
        host = i % 5
        body = [line(rng.randrange(8, 40)) for _ in range(rng.randrange(2, 7))]
        want[i] = " ".join(body).split()
        inner = "".join(f"<p>{x}</p>" for x in body)
        if i % 2:  # markup tells; the advert is new on every page, and the licence is shared
            want[i] += "This text is free to copy".split()
            page = f"<nav>{line(4)}</nav><article>{inner}<p>This text is free to copy</p></article><aside class='ad'>{line(6)}</aside>"
        else:
            page = f"<div>{inner}</div>"
        top, end = ("".join(f"<div>{x}</div>" for x in part) for part in (menus[host][:3], menus[host][3:]))
        rows.append((i, f"http://h{host}.x/{'a' if i % 2 else 'b'}/{i}", f"<body>{top}{page}{end}</body>"))
    rows += [(1000, "http://alone.x/", f"<p>{line(50_000)}</p>")]
    pages = spark.createDataFrame([(*r, 7, "t") for r in rows + rows[:2]], "page_id long, url string, html string, n_chars int, text string")
    got = {r["page_id"]: r["text"].split() for r in html_text.extract(pages, per_range=9).collect()}
    both = sum(sum((Counter(got[i]) & Counter(want[i])).values()) for i in want if i > 1)
    assert both / sum(len(want[i]) for i in want if i > 1) > 0.99 and both / sum(len(got[i]) for i in want if i > 1) > 0.99
    assert len(got[1000]) == 50_000
    # the difference deletes as many lines as the plain alignment with a neighbour shares
    brute = html_brute(rows)
    for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), per_range=7, why=True).collect():
        own, most = brute[r["page_id"]]
        said = r["text"].split(",")
        gone = sum(v in ("shared", "restored") for v in said)
        assert len(said) == len(own) and gone in (0, *most)
        assert gone or not most


# -- 8 mixing
def test_fill_targets():
    assert mixing.fill_targets([100, 100], [1, 3]) == [50, 150]
    assert mixing.fill_targets([10, 100, 100], [2, 1, 1]) == [30, 90, 90]
    assert sum(mixing.fill_targets([1, 2, 300, 0], [3, 2, 1, 1])) == pytest.approx(303)
    assert mixing.fill_targets([], []) == []


def test_mixing(corpus, nothing):
    got = mixing.mix_to_weights(corpus, F.array("source")).collect()
    size = Counter()
    for r in corpus.collect():
        size[r["source"]] += len(WORD.findall(r["text"] or ""))
    sources = sorted(size, key=lambda s: (s is None, s or ""))
    want = dict(zip(sources, mixing.fill_targets([size[s] for s in sources], [1, 2, 3, 1]), strict=True))
    taken, largest = Counter(), max(r["size"] for r in got)
    for r in got:
        (s,) = r["pattern"]
        taken[s] += r["taken"]
        assert r["source_size"] == [size[s]] and r["target"] == [want[s]]
        assert r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
    assert len(got) == corpus.count()
    assert all(abs(taken[s] - want[s]) <= largest for s in sources)
    assert Counter(map(str, got)) == Counter(map(str, mixing.mix_to_weights(corpus.repartition(7), F.array("source")).collect()))
    copies = Counter(r["doc_id"] for r in mixing.take_mix(corpus, F.array("source")).collect() if r["doc_id"] is not None)
    by = Counter()
    for r in got:
        if r["size"] and r["doc_id"] is not None:
            by[r["doc_id"]] += r["taken"] // r["size"]
    assert copies == +by
    assert mixing.mix_to_weights(nothing, F.array("source")).count() == 0


def mix_by_hand(rows):
    """Targets by exact fractions, then the cut by one walk over the seeded
    order: {(doc_id, source, size, taken): rows} of rows (doc_id, text, source)."""
    from fractions import Fraction

    size = Counter()
    for _, t, s in rows:
        size[s] += len(WORD.findall(t or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    while open_:
        left = sum(size.values()) - sum(target.values())
        part = {s: Fraction(left * weight[s], sum(weight[x] for x in open_)) for s in open_}
        over = {s for s in open_ if part[s] > 3 * size[s]}
        target |= {s: Fraction(3 * size[s]) for s in over} if over else part
        open_ = open_ - over if over else set()
    want = Counter()
    for s in order:
        own = sorted(((hashlib.md5(f"17:{'' if i is None else i}:{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest(), i, len(WORD.findall(t or ""))) for i, t, x in rows if x == s), key=lambda r: r[0])
        whole, rest = divmod(int(target[s]), size[s]) if size[s] else (0, 0)
        at = 0
        for _, i, n in own:
            want[i, s, n, n * (whole + (n > 0 and at < rest and at + n / 2 <= rest))] += 1
            at += n
    return want, target


def test_mixing_targets_and_cut_by_hand(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" * rng.randrange(1, 30)), rng.choice(["a", "b", "c", "d", None])) for i in range(400)] + [(None, f"x {'y ' * (i % 9)}{i}", "b") for i in range(300)] + [(1, None, "a"), (2, "", None)]
    want, target = mix_by_hand(rows)
    got = mixing.mix_to_weights(spark.createDataFrame(rows, "doc_id long, text string, source string"), F.array("source")).collect()
    assert Counter((r["doc_id"], r["pattern"][0], r["size"], r["taken"]) for r in got) == want
    assert all(r["target"][0] == pytest.approx(float(target[r["pattern"][0]])) for r in got)


def test_mixing_ties_and_names(spark):
    """Rows without an id are told apart, equal rows are split, clashing columns stay."""
    rows = [(None, f"word {i}", "p" if i % 3 else "q", 1, 2) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target int, cut int").withColumns({c: F.lit(c) for c in ("last", "whole", "rest", "source_size", "size", "pattern", "__p", "__h")})
    for table, near in ((docs, 4), (docs.withColumn("text", F.lit("same words")), 300)):
        got = mixing.mix_to_weights(table, F.array("source")).groupBy("source_size", "target").agg(F.sum("taken").alias("t")).collect()
        assert len(got) == 2 and all(abs(r["t"] - r["target"][0]) <= near for r in got)
        taken = mixing.take_mix(table, F.array("source"))
        assert taken.columns == docs.columns
        by = {r["source"]: r["n"] for r in taken.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()}
        assert all(abs(by[s] - t) <= near for s, t in (("p", 4000 / 3), ("q", 8000 / 3)) if s in by)


def test_flow_is_least_cost():
    """Against every division of small patterns over their sources."""
    from itertools import product

    rng = random.Random(4)
    for _ in range(60):
        members = rng.sample([("a",), ("b",), ("a", "b"), ("c",), ("b", "c"), ("a", "b", "c")], 3)
        patterns = [(m, rng.randrange(0, 3)) for m in members]
        quotas = {s: rng.randrange(0, 5) for s in "abc"}
        cost = lambda used: sum(max(0, min(u, 2 * n) - n) + 3 * max(0, u - 2 * n) for u, (_, n) in zip(used, patterns, strict=True))  # noqa: E731, B023
        ways = [[w for w in product(*(range(3 * n + 1) for _ in m)) if sum(w) <= 3 * n] for m, n in patterns]
        best = None
        for w in product(*ways):
            got = Counter()
            for (m, _), give in zip(patterns, w, strict=True):
                got.update(dict(zip(m, give, strict=True)))
            if all(got[s] <= quotas[s] for s in quotas):
                key = (-got.total(), cost([sum(x) for x in w]))
                best = key if best is None else min(best, key)
        flows = mixing.route_tokens(patterns, quotas)
        used = [sum(f.values()) for f in flows]
        assert (-sum(used), cost(used)) == best
        assert all(sum(f.get(s, 0) for f in flows) <= quotas[s] for s in quotas)


def test_flow_prefers_fresh_text_and_overlap():
    flows = mixing.route_tokens([(("a",), 10), (("a", "b"), 10), (("b",), 2)], {"a": 15, "b": 12})
    out = {s: sum(f.get(s, 0) for f in flows) for s in "ab"}
    assert out == {"a": 15, "b": 12}
    used = [sum(f.values()) for f in flows]
    cost = sum(max(0, min(u, 2 * n) - n) + 3 * max(0, u - 2 * n) for u, n in zip(used, (10, 10, 2), strict=True))
    assert cost == 5  # 27 tokens of 22: five are second uses, none a third


# -- 9 sharding
@pytest.mark.parametrize("tolerance", [0.015, 0.5])
def test_sharding(corpus, nothing, tolerance):
    got = sharding.shard_by_bytes(corpus, 4, tolerance).collect()
    rows = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1) for r in corpus.collect())
    assert Counter((r["doc_id"], r["size"]) for r in got) == rows
    for k in range(4):
        slots = sorted(r["slot"] for r in got if r["shard"] == k)
        assert slots == list(range(len(slots)))
    total, largest = sum(r["size"] for r in got), max(r["size"] for r in got)
    for k in range(4):
        assert abs(sum(r["size"] for r in got if r["shard"] == k) - total / 4) <= largest + tolerance * total / 4
    assert sharding.shard_by_bytes(nothing).count() == 0


def shards_by_hand(rows):
    """{(doc_id, size, shard, slot): rows} of rows (doc_id, text), by a plain sort."""
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    ordered = sorted(((md5(t or "")[:3], md5(f"{'' if i is None else i}:{md5(t or '')}"), i, len((t or "").encode()) + 1) for i, t in rows), key=lambda r: r[:2])
    bins, target = Counter(), sum(r[3] for r in ordered) / 16
    for b, _, _, n in ordered:
        bins[b] += n
    at, before, slots, want = 0, {}, Counter(), Counter()
    for b, _, i, n in ordered:
        before.setdefault(b, at)
        at += n
        k = min(15, int((before[b] + bins[b] / 2 if bins[b] <= target * 0.015 else at - n / 2) // target))
        want[i, n, k, slots[k]] += 1
        slots[k] += 1
    return want


def test_sharding_cells_leave_the_order(spark, monkeypatch):
    """Small cells, a text and a row that repeat: shards and slots are those of a plain sort."""
    rows = [(i, f"text {i % 90}") for i in range(400)] + [(i, "hot text of many") for i in range(1000, 1500)] + [(None, "null id")] * 200 + [(3, None), (4, "")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, size int")
    whole = Counter(map(tuple, sharding.shard_by_bytes(docs).collect()))
    monkeypatch.setattr(sharding, "CELL", 8)
    assert Counter(map(tuple, sharding.shard_by_bytes(docs.repartition(5)).collect())) == whole
    assert Counter((i, n, k, slot) for i, n, _, k, slot in whole.elements()) == shards_by_hand(rows)


# -- 10 warc
def test_warc_round_trip(spark, tmp_path):
    rows = [(i, f"http://h/{i}?q=é", f"<p>{'x' * (i * 37 % 900)} é {i % 40}</p>") for i in range(120)] + [(500, "http://a/\r\nb", None), (501, None, ""), (502, "u", "same"), (503, "u", "same"), (504, "u", "same"), (None, "n", "same"), (504, "u", "same")]
    pages = spark.createDataFrame([(*r, 1.5) for r in rows], "page_id long, url string, html string, payload_bytes double")
    outs = []
    for n in (1, 2):
        out = f"file://{tmp_path}/w{n}"
        manifest = warc.write_warc(pages.repartition(n * 3), out, range_bytes=20_000, roll_bytes=4_000)
        assert manifest.where("n_bytes > 8000").count() == 0 and manifest.count() > 3
        outs.append({f.name: f.read_bytes() for f in (tmp_path / f"w{n}").glob("*.warc.gz")})
    assert outs[0] == outs[1]  # the same bytes under the same names
    assert not list((tmp_path / "w1").glob(".tmp*.gz"))
    got = warc.read_warc(spark, out).collect()
    assert len(got) == len(rows) and all(r["intact"] for r in got)
    html = {}
    for i, _, h in rows:
        html[i] = (h or "").encode()
    largest = {}
    for i, h in html.items():
        if i is not None:
            largest[h] = max(largest.get(h, i), i)
    for r in got:
        h = html[r["page_id"]]
        assert r["payload_bytes"] == len(h) and r["payload_digest"] == warc.sha1_base32(h)
        to = None if r["page_id"] is None or largest[h] == r["page_id"] else largest[h]
        assert (r["record_type"], r["refers_to"]) == ("revisit" if to is not None else "response", to)
    data = b"".join(gzip.decompress(b) for b in outs[0].values())
    assert len(re.findall(rb"WARC/1\.0\r\nWARC-Type: re", data)) == len(rows)
    assert data.count(b"WARC/1.0\r\nWARC-Type: warcinfo") == len(outs[0])
    names = {m[0]: m[1] for m in re.findall(rb"WARC-Type: response\r\nWARC-Record-ID: (\S+)[\s\S]*?X-Page-ID: (\d*)", data)}
    refers = re.findall(rb"WARC-Refers-To: (\S+)\r\nX-Refers-To-Page-ID: (\d+)", data)
    assert refers and all(names[a] == b for a, b in refers)
    assert warc.read_warc(spark, str(warc_empty(spark, tmp_path))).count() == 0


def test_warc_ranges(spark, tmp_path):
    """Ranges are equal in bytes whatever the ids are, a hot row is spread, an archive is written once."""
    rows = [(i, f"u{i}", f"{i} " * 200) for i in range(300)] + [(10**15, "far", "x"), (-(2**63), "least", "y"), (2**63 - 1, "most", "y")]
    rows += [(7, "hot", "z" * 1000)] * 200 + [(None, "none", "n" * 1000)] * 100
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = f"file://{tmp_path}/ranges"
    manifest = warc.write_warc(pages.repartition(5), out, range_bytes=30_000).collect()
    most = max(Counter((r["range"]) for r in manifest for _ in range(r["n_records"])).values())
    assert len({r["range"] for r in manifest}) >= 12 and most <= 60
    got = Counter((r["page_id"], r["url"], r["payload_bytes"], r["refers_to"]) for r in warc.read_warc(spark, out).collect())
    assert got == Counter((i, u, len(h), 2**63 - 1 if u == "least" else None) for i, u, h in rows)
    with pytest.raises(FileExistsError):
        warc.write_warc(pages, out)


def warc_empty(spark, tmp_path):
    out = f"file://{tmp_path}/none"
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), out)
    return out
