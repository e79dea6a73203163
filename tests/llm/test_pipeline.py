"""The whole pipeline on a small table with odd rows."""

import numpy as np
import pytest

import corpus_pipeline
from rillstone.llm import sharding


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    rng = np.random.default_rng(9)
    words = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("n", "r", "st", "nd")]
    prose = lambda n: " ".join(w.capitalize() + "." if k % 9 == 8 else str(w) for k, w in enumerate(rng.choice(words, n)))
    rows, labels = [], []
    for i in range(150):
        good = i % 3 > 0
        rows.append((i, prose(60) if good else "BUY!! " * 30 + "### " + prose(5).upper(), "en", "ab"[i % 2], 0, f"extra{i}"))
        labels.append((i, int(good), 0))
    item = prose(14)
    rows += [(None, prose(50), "en", "a", 0, "null 1"), (None, prose(50), "en", "a", 0, "null 2"), (None, item + " " + prose(40), "en", "b", 0, "null leak")]
    rows += [(1, prose(55), None, None, 0, "same id"), (1, rows[1][1], "en", "b", 0, "same id and text"), (900, rows[2][1] + " more", "en", "a", 0, "near copy")]
    rows += [(901, None, "en", "a", None, "null text"), (902, "", "en", "a", 0, "empty")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows


def test_no_clean_row_is_lost(spark, tables):
    folder, rows = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, folder)
        assert kept.columns == docs.columns, name
    extras = {r.size for r in kept.collect()}
    good = {f"extra{i}" for i in range(150) if i % 3 > 0}
    assert good <= extras | {"same id and text"} and {"null 1", "null 2", "same id"} <= extras
    assert len({"extra1", "same id and text"} & extras) == 1  # rows alike in id and text: one of them
    assert not {"null leak", "near copy"} & extras and not {f"extra{i}" for i in range(0, 150, 3)} & extras


def test_run(spark, tables):
    folder, rows = tables
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "shard"]
    got = out.collect()
    assert got and all(0 <= r.shard < 24 and r.n_chars == len(r.text) for r in got)
    places = {(r.doc_id, r.shard) for r in got}
    assert len(places) == len({r.doc_id for r in got})
    assert sharding.with_shards(spark.createDataFrame([(5,)], "doc_id long")).first().shard in range(24)


def test_empty_table(spark, tables, tmp_path):
    folder, _ = tables
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
