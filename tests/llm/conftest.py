from __future__ import annotations

import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.fixture(scope="session")
def sets():
    return shingles


#: Texts that every operator must take: nulls, blanks, one word, odd bytes, repeats.
EDGES = [None, "", "   ", "\n\t\r\x0b\x0c", "word", "a b c", "é ü ß 日本   x", "same words same words same words", "x" * 5000, "tab\tnew\nline\n\nline", "A b C d E f", "a B c D e F", "0", " "]


@pytest.fixture(scope="session")
def corpus(spark):
    """Documents with copies, edited copies at all distances, shared passages,
    edge texts, repeated rows, null ids and sources, and columns of clashing names."""
    rng = random.Random(5)
    vocab = ["w%d" % i for i in range(400)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))

    def edited(t, k):
        w = t.split()
        for _ in range(k):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        return " ".join(w)

    texts = list(EDGES)
    for n in (6, 12, 40, 90, 200, 700):
        base = text(n)
        texts += [base, base.upper(), base + " "]
        texts += [edited(base, k) for k in (1, 1, 2, 3, 5, 8, 12, 20) for _ in range(3)]
    chain = text(120)
    for _ in range(12):  # neighbours link, ends don't
        texts.append(chain)
        chain = edited(chain, 2)
    passage = text(60)
    texts += [text(20) + " " + passage + " " + text(15) for _ in range(25)]
    texts += [text(rng.randrange(1, 300)) for _ in range(60)]
    texts.append(text(30_000))
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "s10", None]), i % 7, "k", 0.5) for i, t in enumerate(texts)]
    rows += rows[20:24] + [(None, text(30), None, None, 0, "k", None), (None, None, None, None, 0, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, size double")


@pytest.fixture(scope="session")
def nothing(corpus):
    return corpus.limit(0)
