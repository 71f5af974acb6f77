"""Every stage of the pipeline and every operator on tables with nulls everywhere, repeated rows, odd texts and clashing column names."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stockloom.llm import decontam, licenses, linededup, mixing, neardup, quality, secrets, tokencount, toxicity

pipeline = pytest.importorskip("corpus_pipeline")
CLASH = ["tag", "first", "rep", "h1", "at", "hash", "value", "n", "kept", "score", "lines", "runs", "__id", "__tag", "key", "part", "size", "item_id", "x", "digest"]
WORDS = "stone river amber willow copper meadow harbor ember lantern gull north old gate field".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(90)) for _ in range(n))


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    """Tables with a benchmark item, labels with nulls and ties, and documents of every odd kind."""
    rng = random.Random(31)
    item = "so Ann walks seven miles from the old harbor to the market near Rome before the sun goes down"
    rows = [(i, prose(rng, 120), "en", f"s{i % 3}", 0) for i in range(30)]
    rows += [(None, prose(rng, 90), None, None, None), (31, None, "en", "s0", None), (32, "", None, "s1", 0), (33, " \n\t ", "en", None, 0), (34, "w " * 30_000, "en", "s2", 0), (35, prose(rng, 60) + " " + item, "en", "s2", 0)]
    rows += [rows[0], rows[0], (1, prose(rng, 100), "en", "s9", 0), (36, rows[2][1], "en", "s0", 0), (37, "é\x00ü ☃ " + prose(rng, 80), "xx", "s1", 0)]
    path = str(tmp_path_factory.mktemp("edges"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH)])
    docs.write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i % 4 > 0), int(i % 9 == 0)) for i in range(30)] + [(None, 1, 1), (3, None, None), (3, 0, 1), (3, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (None, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_every_stage(spark, place):
    docs = spark.read.parquet(f"{place}/documents.parquet")
    rows = Counter(tuple(r) for r in docs.collect())
    by_text = {r[:2]: r for r in rows}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, place)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        got = Counter(tuple(r) for r in out.collect())
        if name == "line dedup":
            assert sum(got.values()) == sum(rows.values()) and Counter(r[0] for r in got.elements()) == Counter(r[0] for r in rows.elements())
        else:
            assert all(got[r] <= rows[r] for r in got), name  # rows only go, none is changed
        ids = Counter(r[0] for r in got.elements())
        if name == "quality rules":
            assert not {31, 32, 33, 34} & set(ids) and Counter(tuple(r) for r in stage(spark, docs.repartition(5), place).collect()) == got
        elif name == "MinHash near-dedup":
            assert ids[0] == 1 and ids[1] == 2 and 36 not in ids and ids[None] == 1 and all(ids[i] == 1 for i in (31, 32, 33, 34))
        elif name == "benchmark decontamination":
            assert rows - got == Counter({by_text[k]: n for k, n in ((r[:2], rows[r]) for r in rows) if k[0] == 35})
        assert stage(spark, docs.limit(0), place).count() == 0
    mixed = pipeline.STAGES[-1][1](spark, docs, place)
    assert mixed.count() == sum(rows.values())


def test_every_operator_keeps_every_row(spark, place):
    P = pytest.importorskip("public_tokenizers")
    docs, labels, bench = (spark.read.parquet(f"{place}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    ids = Counter(r.doc_id for r in docs.select("doc_id").collect())
    outs = {
        "secrets": secrets.scan(docs, secrets.train(docs)), "lines": linededup.dedup(docs), "near": neardup.near_duplicates(docs), "quality": quality.judge(docs, labels), "toxicity": toxicity.score(docs, toxicity.train(docs, labels)),
        "mixing": mixing.mix(docs), "tokens": tokencount.count_tokens(docs, P.path("byte_bpe_50k.json"))}
    for name, out in outs.items():
        assert Counter(r.doc_id for r in out.select("doc_id").collect()) == ids, name
    assert {r.doc_id for r in decontam.matches(docs, bench).collect()} == {35}
    found = licenses.scan(docs, licenses.catalog(spark))
    assert found.count() == docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).distinct().count()


def test_reruns_agree(spark, place):
    docs, labels = (spark.read.parquet(f"{place}/{t}.parquet") for t in ("documents", "labels"))
    for f in (lambda d, x: quality.judge(d, x), lambda d, x: toxicity.score(d, toxicity.train(d, x)), lambda d, x: mixing.mix(d), lambda d, x: secrets.scan(d, secrets.train(d))):
        assert sorted(map(str, f(docs, labels).collect())) == sorted(map(str, f(docs.repartition(7), labels.repartition(2)).collect()))
