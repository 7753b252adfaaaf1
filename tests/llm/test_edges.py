"""Every operator on rows that tables should not have: nulls in all columns,
repeated rows, ids with several texts, very long texts, clashing names."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import decontamination, html_text, language, mixing, near_duplicates, pii, quality, secrets, sharding, warc

LONG = "palabra " * 120_000
#: Names that operators use for columns of their own.
CLASHES = "score kept size shard slot base found spans u seed pattern instance node label key keys cell bin rank place at n b r mark range kind to text_crc32 target cut last whole rest taken item_id value left right held_out".split()


@pytest.fixture(scope="module")
def rows():
    texts = ["one two three four five six seven", "mail a@b.org or 4111 1111 1111 1111", 'token = "4d44c79e8bf7c55759c4958dd60ed83d2ef8cd4e"', " ".join(f"w{i}" for i in range(80))]
    out = [(i, t, "en", "s") for i, t in enumerate(texts)]
    out += out[:2]  # repeated rows
    out += [(0, "another text of the id 0, unlike the first", "fr", None), (1, None, None, "s"), (None, None, None, None), (None, "a text without an id", "en", None), (None, "a text without an id", "en", None)]
    return [*out, (77, LONG, "es", "t"), (78, "", "es", "t")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit(f"own {c}") for c in CLASHES})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (0, 1, 0), (3, 1, None), (None, 1, 0), (2, None, None), (1, 0, 0)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("own"))


def test_one_row_for_each(docs, labels, rows):
    """One result for each row, ids as they are, and equal results for repeated rows."""
    ids = Counter(r[0] for r in rows)
    model = language.learn(docs.where(~language.held_out(F.col("doc_id"))))
    for out in (
        quality.quality(docs, labels),
        pii.find_pii(docs),
        near_duplicates.near_duplicates(docs),
        language.identify(docs, model),
        mixing.mix_to_weights(docs, F.array("source")),
        sharding.shard_by_bytes(docs),
    ):
        assert Counter(r["doc_id"] for r in out.select("doc_id").collect()) == ids, out.columns


def test_null_and_empty_texts(docs, labels):
    """Null and empty texts have the results that the docstrings name."""
    empty = docs.where("text is null or text = ''")
    assert {(r["n_words"], r["base_failed"], r["kept"], r["score"]) for r in quality.quality(empty, labels).collect()} == {(0, True, False, None)}
    assert {(r["n_email"], r["spans"]) for r in pii.find_pii(empty).collect()} == {(0, "")}
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_duplicates.near_duplicates(empty).collect()} == {(1, 0, 1), (None, 0, None), (78, 0, 78)}
    assert {(r["lang_pred"], r["score"]) for r in language.identify(empty, language.learn(docs)).collect()} == {("und", 0.0)}
    assert {(r["size"], r["taken"]) for r in mixing.mix_to_weights(empty, F.array("source")).collect()} == {(0, 0)}
    assert {(r["size"], r["text_crc32"]) for r in sharding.shard_by_bytes(empty).collect()} == {(1, 0)}
    assert secrets.scan(empty).count() == 0


def test_filters_keep_the_columns(spark, docs, labels):
    """Stages give back the columns they got, clashing names included."""
    bench = spark.createDataFrame([(1, "one two three four five six"), (1, "nothing of the kind at all"), (None, None), (2, "")], "item_id long, text string").withColumn("doc_id", F.lit(1))
    for out in (quality.keep_good(docs, labels), near_duplicates.keep_one_of_each(docs), decontamination.drop_contaminated(docs, bench), mixing.take_mix(docs, F.array("source"))):
        assert out.columns == docs.columns
        assert all(r["score"] == "own score" for r in out.collect())
    # the row with the item goes, and its repetition; another text of its id stays
    left = Counter(r["doc_id"] for r in decontamination.drop_contaminated(docs, bench).collect())
    assert left[0] == 1 and left[1] == 3
    # of repeated rows one stays, and every text of an id
    one = Counter(r["doc_id"] for r in near_duplicates.keep_one_of_each(docs).collect())
    assert one[0] == 2 and one[1] == 2 and one[None] == 2


def test_long_texts_are_read_whole(docs):
    n = len(LONG.split())
    found = {r["doc_id"]: r for r in mixing.mix_to_weights(docs, F.array("source")).collect()}
    assert found[77]["size"] == n
    assert {r["doc_id"]: r["size"] for r in sharding.shard_by_bytes(docs).collect()}[77] == len(LONG) + 1
    assert {r["doc_id"]: r["n_shingles"] for r in near_duplicates.near_duplicates(docs).collect()}[77] == 1


def test_pages(spark, tmp_path):
    rows = [(1, "http://h/a", "<p>a b</p>"), (1, "http://h/a", "<p>a b</p>"), (1, "http://h/b", "<p>other</p>"), (None, None, None), (2, None, "<p>" + "x " * 300_000), (3, "http://h/c", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(f"own {c}") for c in CLASHES})
    ids = Counter(r[0] for r in rows)
    text = html_text.extract(pages, per_range=2).collect()
    assert Counter(r["page_id"] for r in text) == ids
    assert {r["n_chars"] for r in text if r["page_id"] == 2} == {2 * 300_000 - 1}
    out = f"file://{tmp_path}/warc"
    warc.write_warc(pages, out, range_bytes=1000)
    back = warc.read_warc(spark, out).collect()
    assert Counter(r["page_id"] for r in back) == ids and all(r["intact"] for r in back)


def test_empty_tables(docs, labels):
    none = docs.limit(0)
    assert quality.quality(none, labels.limit(0)).count() == pii.find_pii(none).count() == sharding.shard_by_bytes(none).count() == 0
    assert mixing.take_mix(none, F.array("source")).count() == near_duplicates.keep_one_of_each(none).count() == secrets.scan(none).count() == 0
