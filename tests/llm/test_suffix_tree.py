"""What the suffix tree of ``op8_suffix_tree`` packs, and what it leaves on disk."""

import glob
import os
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from partner_analytics.llm import common, suffix_tree
from partner_analytics.llm.common import staged, words

TEXTS = [None, "", " \n", "A b  a B", "\x0bone\x1ctwo\x0cthree\x85 four five\t", "eightbyt eightbyte sixteenbytesword seventeenbytewords", "x\x00 x", "ÚJ új", "tail", "a " * 300]


def test_words_by_position_are_those_by_text():
    for texts in (TEXTS, TEXTS[3:7], [None], []):
        data, begin, end, n = suffix_tree.words_at(pa.array(["cut off", *texts], pa.string()).slice(1))
        want = [words(t) for t in texts]
        assert n.tolist() == [len(x) for x in want]
        flat = [w for x in want for w in x]
        assert [data[a:b].tobytes() for a, b in zip(begin, end)] == flat
        assert suffix_tree.hashes_at(data, begin, end).tolist() == suffix_tree.hashed(flat).tolist()
    every = sorted({w for t in TEXTS for w in words(t)} | {b"", b"\x00", b"\x00\x00"})
    assert len(set(suffix_tree.hashed(every).tolist())) == len(every)


def shuffle_files(spark):
    """Shuffle files of this session on disk."""
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in dirs for f in glob.glob(f"{d.getPath()}/*/shuffle_*.data")}


def test_a_stage_that_runs_once_leaves_no_shuffle(workers):
    frame = workers.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    before = shuffle_files(workers)
    assert staged(frame, "kept").count() == 7
    kept = shuffle_files(workers)
    assert kept - before
    assert staged(workers.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "once", once=True).agg(F.sum("count")).first()[0] == 1000
    for _ in range(100):
        left = {f for f in shuffle_files(workers) - kept if os.path.getsize(f) > 100}  # those of the sum above are tiny
        if not left:
            break
        time.sleep(0.1)
    assert not left


def test_only_staged_tables_are_deleted(workers, tmp_path):
    workers.range(3).write.parquet(f"{tmp_path}/input")
    with pytest.raises(ValueError):
        common.forget(workers.read.parquet(f"{tmp_path}/input"))
    assert workers.read.parquet(f"{tmp_path}/input").count() == 3


@pytest.mark.parametrize("near", [10**6, 30])
def test_only_scores_stay_on_disk(workers, tmp_path, monkeypatch, near):
    """Counts, pairs, contexts and the tree go once nothing reads them; parts of any size give the same scores."""
    rng = np.random.default_rng(5)
    docs = [(i, " ".join(f"w{x}" for x in rng.integers(0, 60, 40)) if i % 9 else None) for i in range(200)]
    frame = workers.createDataFrame([*docs, *docs[:20], (None, "w1 w2 w3 never")], "doc_id long, text string")
    want = sorted(tuple(r) for r in suffix_tree.score(frame, F.col("doc_id") % 5 != 1).drop("doc_id").collect())
    monkeypatch.setattr(suffix_tree, "NEAR", near)
    monkeypatch.setattr(suffix_tree, "PART_GRAMS", 50)
    monkeypatch.setattr(common, "shared_folder", lambda spark: f"{tmp_path}/a folder")
    got = sorted(tuple(r) for r in suffix_tree.score(frame, F.col("doc_id") % 5 != 1).drop("doc_id").collect())
    assert {x.split("-")[0] for x in os.listdir(f"{tmp_path}/a folder")} == {"scores"}
    assert len(got) == len(want) == 221 and np.allclose(np.array(got, float), np.array(want, float), rtol=1e-9)
