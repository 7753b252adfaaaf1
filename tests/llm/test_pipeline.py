"""The pipeline, stage by stage, against its operators' contracts."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from tests.llm.test_near_duplicates import brute
from tests.llm.test_operators import mix_by_hand, quality_by_hand, shards_by_hand

from tessera.llm.decontamination import drop_contaminated
from tessera.llm.near_duplicates import keep_one_of_each


@pytest.fixture(scope="module")
def sf_dir(spark, corpus, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("sf"))
    corpus.write.parquet(f"{out}/documents.parquet")
    corpus.where("doc_id % 2 = 0").select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{out}/labels.parquet")
    long = next(r["text"] for r in corpus.where("length(text) > 1000 and length(text) < 3000").collect())
    spark.createDataFrame([(1, " ".join(long.split()[10:40])), (2, "no such words are there in it")], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def test_stages(spark, sf_dir, sets):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    labels, bench = spark.read.parquet(f"{sf_dir}/labels.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    steps = []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf_dir)
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        steps.append(name)
        if name != "sharding":
            assert docs.columns == columns
        ids = [r["doc_id"] for r in rows]
        if name == "quality_rules":
            texts = dict(enumerate((r["doc_id"], r["text"]) for r in before.collect()))
            good = {r["doc_id"] for r in labels.collect()}
            *_, kept = quality_by_hand({k: t for k, (_, t) in texts.items()}, {k: True for k, (i, _) in texts.items() if i in good})
            assert Counter(ids) == Counter(i for k, (i, _) in texts.items() if kept[k]) and ids
        elif name == "jaccard_join":
            want = {d for d, _, c in brute([(r["doc_id"], r["text"]) for r in before.collect()], sets) if d == c and d is not None}
            assert {d for d in ids if d is not None} == want
        elif name == "decontamination":
            items = [sets(b["text"]) for b in bench]
            bad = {r["doc_id"] for r in before.collect() if any(len(q & sets(r["text"])) >= 0.8 * len(q) for q in items)}
            assert set(ids) == {r["doc_id"] for r in before.collect()} - bad and bad
        elif name == "mixing":
            want, _ = mix_by_hand([(r["doc_id"], r["text"], r["source"]) for r in before.collect()])
            assert Counter(ids) == +Counter({i: taken // n * m for (i, _, n, taken), m in want.items() if n})
        else:
            want = shards_by_hand([(r["doc_id"], r["text"]) for r in before.collect()])
            assert Counter((r["doc_id"], r["size"], r["shard"], r["slot"]) for r in rows) == want
    assert steps == ["quality_rules", "jaccard_join", "decontamination", "mixing", "sharding"]
    got = sorted(map(str, corpus_pipeline.run(spark, sf_dir).collect()))
    assert got == sorted(map(str, rows))


def test_empty_tables(spark, sf_dir, corpus, tmp_path):
    out = str(tmp_path / "none")
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(f"{out}/{t}.parquet")
    assert corpus_pipeline.run(spark, out).count() == 0


def test_rows_without_or_with_repeated_ids(spark):
    """Rows are judged each, not by an id that they share or lack."""
    text = lambda k: " ".join(f"{k}{i}" for i in range(40))
    rows = [(1, text("a")), (2, text("b")), (2, text("c")), (3, text("c")), (2, text("d")), (None, text("a")), (None, text("e")), (None, text("e")), (4, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, keep_one_of_each(docs).collect()), key=repr)
    assert got == sorted([(1, text("a")), (2, text("b")), (2, text("c")), (2, text("d")), (None, text("e")), (4, None), (None, None)], key=repr)
    bench = spark.createDataFrame([(None, text("b")), (7, text("e"))], "item_id long, text string")
    left = drop_contaminated(docs, bench).collect()
    assert sorted(map(tuple, left), key=repr) == sorted([r for r in rows if r[1] not in (text("b"), text("e"))], key=repr)


def test_repeated_id_keeps_its_unique_text(spark):
    """An id that one row shares with a copy doesn't take its other text along."""
    text = lambda k: " ".join(f"{k}{i}" for i in range(60))
    rows = [(5, text("u")), (5, text("t") + " more"), (3, text("t"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, keep_one_of_each(docs).collect())) == [(3, text("t")), (5, text("u"))]


def test_run_leaves_one_folder(spark, sf_dir):
    """Only the last stage's input stays in the shared folder."""
    from pathlib import Path

    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(shared.glob("staged-*"))
    corpus_pipeline.run(spark, sf_dir).count()
    left = set(shared.glob("staged-*")) - before
    assert sum("staged-mixing" in x.name for x in left) == 1 and not any(x.name.startswith(f"staged-{k}") for x in left for k in ("quality", "jaccard", "decontamination", "edges", "sets"))
