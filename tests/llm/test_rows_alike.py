"""Rows that repeat or have no id: licences count a text once, the mix treats each row apart."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stockloom.llm import licenses, mixing


def test_licences_of_repeated_rows(spark):
    notice = "x\nReleased under the MIT License.\nand again\nReleased under the MIT License."
    rows = [(1, notice), (1, notice), (1, notice + "\n"), (2, "Released under the MIT License."), (None, notice), (None, notice), (3, None)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), licenses.catalog(spark)).collect()
    assert sorted((str(r.doc_id), r.license or "", r.notices, r.n_notices) for r in got) == sorted([("1", "", "MIT", 2), ("1", "", "MIT", 2), ("2", "MIT", "MIT", 1), ("None", "", "MIT", 2), ("3", "", "", 0)])


def test_whole_licences_of_a_folder(spark, tmp_path):
    """Long licences come from a folder: here any that the machine has, else texts of our own."""
    there = sorted(p for p in Path("/usr/share/common-licenses").glob("*") if p.is_file() and not p.is_symlink() and p.stat().st_size > 5000)
    texts = {p.name: p.read_text(errors="replace") for p in there} or {f"Own-{k}": " ".join(random.Random(k).choices("you may copy this work and its parts".split(), k=900)) for k in range(3)}
    for name, text in texts.items():
        (tmp_path / f"{name}.txt").write_text(text)
    known = licenses.catalog_of_folder(spark, str(tmp_path))
    other = {name: text.upper().replace("LICENSE", "licence").replace("\n", "\n  ") for name, text in texts.items()}
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts.values(), *other.values(), "none of them"])], "doc_id long, text string")
    got = {r.doc_id: r.license for r in licenses.scan(docs, known).collect()}
    assert [got[i] for i in range(2 * len(texts))] == [*texts, *other] and got[2 * len(texts)] is None


def told(rows):
    """Fair queueing over whole lists; of rows alike the first goes first."""
    import hashlib
    import re

    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    docs = [("1" if s is None else "0" + s, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), md5(("" if i is None else str(i)) + ":" + md5(t or "")), i) for i, t, s in rows]
    by = {}
    for k, n, *_ in docs:
        by[k] = by.get(k, 0) + n
    weight = {k: j % 3 + 1 for j, k in enumerate(sorted(by))}
    target, open_, left = {}, set(by), float(sum(by.values()))
    while open_:
        share = left / sum(weight[k] for k in open_)
        over = [k for k in open_ if share * weight[k] >= 3 * by[k]]
        if not over:
            target |= {k: share * weight[k] for k in open_}
            break
        for k in over:
            target[k] = 3.0 * by[k]
            left -= target[k]
            open_.remove(k)
    queue = []
    for k in by:
        upto = 0
        for n, mark, j in sorted(((d[1], d[2], j) for j, d in enumerate(docs) if d[0] == k), key=lambda x: x[1:]):
            upto += n
            queue += [((c * by[k] + upto) / target[k], mark, j, c, n) for c in range(3) if n]
    spent, taken = 0, [0] * len(docs)
    for _, _, j, _, n in sorted(queue):
        spent += n
        if spent > sum(by.values()):
            break
        taken[j] += n
    return sorted((str(d[3]), d[1], by[d[0]], round(target[d[0]], 6), taken[j]) for j, d in enumerate(docs))


@pytest.mark.parametrize("seed", [1, 2])
def test_mix(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice([None, *range(40)]), r.choice([None, "", "a b", "a b c", "w " * r.randint(1, 60)]), r.choice([None, "x", "y", "z", "ö"])) for _ in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = sorted((str(x.doc_id), x["size"], x.source_size, round(x.target, 6), x.taken) for x in mixing.mix(df).collect())
    assert got == told(rows)


def test_mix_of_one_text_without_ids(spark):
    """Thousands of rows alike: near the target all the same, and dealt over many partitions."""
    rows = spark.range(6000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same old words").alias("text"), F.when(F.col("id") % 3 > 0, "a").otherwise("b").alias("source"))
    by = {r.s: r for r in mixing.mix(rows).groupBy(F.col("source_size").alias("s")).agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()}
    assert len(by) == 2 and all(abs(r.taken - r.target) <= 3 for r in by.values())
