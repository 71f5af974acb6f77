"""The pipeline on a small planted corpus."""

from __future__ import annotations

import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    word = lambda: rng.choice(["stone", "river", "amber", "willow", "copper", "meadow", "harbor", "ember"]) + str(rng.randrange(200))
    prose = lambda n: "\n".join(" ".join(word() for _ in range(12)) + "." for _ in range(n // 12))
    item = "the quick copper lantern swings above a silent harbor while seven grey gulls circle twice around it"
    clean = [(i, prose(120), "en", f"s{i % 3}", 0) for i in range(60)]
    junk = [(100 + i, " ".join(f"{word()}$$$ {word()}&&&" for _ in range(60)), "en", "s0", 0) for i in range(30)]
    copies = [(200 + i, clean[0][1] + " tail", "en", "s1", 0) for i in range(5)]
    leak = [(300, prose(60) + "\n" + item + "\n" + prose(60), "en", "s2", 0)]
    odd = [(400, None, None, None, None), (401, "", "en", None, 0)]
    spark.createDataFrame(clean + junk + copies + leak + odd, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] < 100), 0) for r in clean + junk], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    mix = {r.doc_id: r for r in pipeline.run(spark, str(tmp_path)).collect()}
    assert set(range(60)) <= set(mix)
    ids = {i for i, r in mix.items() if r.size > 0}  # a document whose lines all repeat others stays empty
    assert not ids & ({r[0] for r in junk} | {r[0] for r in copies[1:]} | {300, 400, 401})
    # the copies' lines went with line dedup; of what each had of its own, one stays
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
