"""Known licences in the forms in which they are distributed, and catalogues of the caller."""

from __future__ import annotations

import textwrap
from pathlib import Path

import pytest

from stockloom.llm import licenses


def found(spark, texts, known, **options):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in licenses.scan(rows, known, **options).collect()}


def test_wrapped_and_signed_forms(spark):
    cases = []
    for name, text in licenses.KNOWN:
        if "\n" not in text:
            continue
        for width in (30, 47, 64, 80, 10_000):
            wrapped = "\n".join("\n".join(textwrap.wrap(line, width)) for line in text.split("\n"))
            for head in ("", "Copyright (c) 2020 A. Holder\n\n", "(C) Copyright 1999, 2001 by Some Body. All rights reserved.\n", "# Copyright 2011-2015 the authors\n"):
                cases.append((name, head + wrapped))
                cases.append((name, "\n".join(" * " + x for x in (head + wrapped.upper()).split("\n"))))
    got = found(spark, [t for _, t in cases], licenses.catalog(spark))
    assert [i for i, (name, _) in enumerate(cases) if got[i].license != name] == []


def test_wording_at_a_line_start_stays(spark):
    known = licenses.catalog(spark, [("X", "you keep the above copyright notice, and the copyright holders\nare named")])
    got = found(spark, ["You keep the above\ncopyright notice, and the\ncopyright holders are named", "you keep the above and the are named", None, "", "..."], known)
    assert [got[i].license for i in range(5)] == ["X", None, None, None, None]


def test_notices_of_the_caller(spark):
    known = licenses.catalog(spark, [("House", "For use within the house only.")])
    texts = ["some text\nfor use WITHIN the house, only\nmore"]
    assert found(spark, texts, known)[0].notices == "" and found(spark, texts, known, mention=None)[0].notices == "House" and found(spark, texts, known, mention="house")[0].n_notices == 1


def test_folder_of_texts(spark, tmp_path):
    shipped = Path("/usr/share/common-licenses")
    if not (shipped / "Apache-2.0").exists():
        pytest.skip("no licence texts on this machine")
    for name in ("Apache-2.0", "GPL-3", "LGPL-2.1", "MPL-2.0", "CC0-1.0"):
        (tmp_path / f"{name}.txt").write_text((shipped / name).read_text())
    known = licenses.catalog_of_folder(spark, str(tmp_path))
    text = {p.stem: p.read_text() for p in tmp_path.iterdir()}
    forms = [(n, f) for n, t in text.items() for f in (t, t.upper(), "Copyright (c) 2024 Me\n\n" + t, "\n".join("   " + x.strip() for x in t.split("\n")), t.replace("\n", "\r\n"))]
    got = found(spark, [f for _, f in forms], known)
    assert [got[i].license for i in range(len(forms))] == [n for n, _ in forms]
