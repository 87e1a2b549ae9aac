"""What op8 keeps on disk: strings of hot anchors are records, and the shuffles of a finished step go."""

from __future__ import annotations

import random
import time

import numpy as np
from pyspark.sql import functions as F

from spanloom.llm import repeats, shared


def _shuffle_files(spark) -> int:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))


def test_strings_of_hot_anchors_travel_as_small_records(spark, monkeypatch):
    rng = random.Random(8)
    line = "This line of a licence stands in every document at hand. "
    own = lambda: "".join(rng.choice("abcdefgh ") for _ in range(90))
    docs = spark.createDataFrame([(i, own() + line + own()) for i in range(400)], "doc_id long, text string").repartition(4)
    kept, whole = {}, repeats.stored

    def watched(df, name, **how):
        kept[name] = whole(df, name, **how)
        return kept[name]

    monkeypatch.setattr(repeats, "stored", watched)
    few = repeats.remove_repeats(docs, hot=50).collect()
    sizes = kept["pieces"].select(F.sum(F.length("bytes")), F.count("*")).first()
    many = repeats.remove_repeats(docs).collect()
    assert sorted(few) == sorted(many)
    starts = kept["pieces"].select(F.sum(F.length("bytes") - repeats.WIDTH + 1)).first()[0]  # strings of all stretches to compare
    assert starts > 10_000 and sizes[0] < 25 * starts and sizes[1] < starts / 2


def test_two_hashes_of_each_string():
    data = np.frombuffer(random.Random(2).randbytes(300) * 2, np.uint8)
    one, two = repeats.strings(data)
    assert len(one) == len(two) == 551 and len(set(one.tolist())) == len(set(two.tolist())) == 300
    assert (one[:251] == one[300:]).all() and (two[:251] == two[300:]).all() and not (one == two).any()


def test_stored_rows_leave_no_shuffle_behind(spark):
    before = _shuffle_files(spark)
    setting = spark.conf.get(shared._RELEASE)
    rows = shared.stored(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count(), "counts", release=True)
    assert spark.conf.get(shared._RELEASE) == setting
    for _ in range(100):
        if _shuffle_files(spark) <= before:
            break
        time.sleep(0.1)
    assert _shuffle_files(spark) <= before
    assert rows.agg(F.sum("count")).first()[0] == 1000
