import math

import pytest
from pyspark.sql import functions as F

from quillstone.llm.licences import scan_licences, licence_statements
from quillstone.llm.mixing import mix_sources, poisson_thresholds, source_rates, uniform

KIND = "doc_id long, text string, source string, copy string"


def test_poisson_thresholds(spark):
    for rate in (0.0, 0.3, 1.0, 7.5, 900.0):
        got = spark.range(1).select(poisson_thresholds(F.lit(rate))).first()[0]
        total, wanted = 0.0, []
        for k in range(len(got)):
            total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) if rate else float(k == 0)
            wanted.append(total)
        assert got == pytest.approx(wanted, abs=1e-9) and got[-1] == pytest.approx(1)


def test_rates_follow_the_weights(spark):
    rows = [(k, "t", "a" if k < 3000 else "b" if k < 3900 else None, "old") for k in range(4000)]
    docs = spark.createDataFrame(rows, KIND)
    weights = spark.createDataFrame([("a", 1.0), ("b", 2.0), (None, 1.0), ("nowhere", 9.0)], "source string, weight double")
    rates = {r["name"]: (r["share"], r["rate"]) for r in source_rates(docs, weights).collect()}
    assert rates == {"a": (0.25, pytest.approx(1 / 3)), "b": (0.5, pytest.approx(20 / 9)), None: (0.25, 10.0)}
    mixed = mix_sources(docs, weights)
    assert mixed.columns == docs.columns
    count = {r["source"]: r["count"] for r in mixed.groupBy("source").count().collect()}
    for name, expected in (("a", 1000), ("b", 2000), (None, 1000)):
        assert abs(count[name] - expected) < 6 * math.sqrt(expected)
    copies = {(r["doc_id"], r["copy"]) for r in mixed.collect()}
    assert len(copies) == sum(count.values()) and copies == {(r["doc_id"], r["copy"]) for r in mix_sources(docs.repartition(7), weights).collect()}


def test_mixing_edges(spark):
    docs = spark.createDataFrame([(1, None, "a", ""), (None, "", None, ""), (1, None, "a", "")], KIND)
    assert mix_sources(docs.limit(0)).count() == 0
    assert all(r["rate"] == 1.0 for r in source_rates(docs, None, by_length="text").collect())
    assert mix_sources(docs, epochs=50).where("doc_id = 1").groupBy("copy").count().where("count <> 2").count() == 0
    clash = docs.withColumns({"mix_source": F.lit(1), "mix_cdf": F.lit(2), "MIX_N": F.lit(3), "mix_order": F.lit(4)})
    mixed = mix_sources(clash, epochs=9)
    assert mixed.columns == ["doc_id", "text", "source", "mix_source", "mix_cdf", "MIX_N", "mix_order", "copy"]
    assert {tuple(r)[3:7] for r in mixed.collect()} == {(1, 2, 3, 4)}
    none = spark.createDataFrame([("a", 0.0)], "source string, weight double")
    assert mix_sources(docs, none).count() == 0
    u = spark.range(1000).select(uniform(F.col("id"), 1).alias("u"))
    assert 0.45 < u.agg(F.avg("u")).first()[0] < 0.55


MIT_FILE = """The MIT License (MIT)

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""


def test_statements(spark):
    texts = {
        1: ("A story about apes.\nLicensed under the Apache License, Version 2.0.\nReleased  under the MIT license\nThis licence is unlike any other one that people know of\n", {"Apache-2.0", "MIT"}),
        2: (None, set()), 3: ("", set()),
        4: ("x " * 100_000 + "\nLicensed under CC BY-NC 4.0.", {"CC-BY-NC-4.0"}),
        5: (MIT_FILE, {"MIT"}),
        6: ("# SPDX-License-Identifier: BSD-3-Clause\nimport os", {"BSD-3-Clause"}),
        7: ("/*\n * This program is free software: you can redistribute it and/or modify it\n * under the terms of the GNU General Public License as published by the Free\n * Software Foundation, either version 3 of the License, or (at your option) any\n * later version.\n */", {"GPL-3.0"}),
        8: ("Text of a page.\nAll rights reserved.", {"Proprietary"}),
        9: ("the terms of this work and the use of it by any person are in the text, as is the part above", set()),
    }
    docs = spark.createDataFrame([(k, t) for k, (t, _) in texts.items()], "doc_id long, text string")
    got = {}
    for r in licence_statements(docs).collect():
        got.setdefault(r["id"], set()).add(r["license"])
    assert all(wanted <= got.get(k, set()) and bool(wanted) == (k in got) for k, (_, wanted) in texts.items())
    best = {r["doc_id"]: r["license"] for r in scan_licences(docs, F.lit(None).cast("string")).collect()}
    assert best == {1: "Apache-2.0", 2: None, 3: None, 4: "CC-BY-NC-4.0", 5: "MIT", 6: "BSD-3-Clause", 7: "GPL-3.0", 8: "Proprietary", 9: None}


def test_inheritance(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [
        (1, "LICENSE", mit), (2, "a/LICENSE", gpl + "\n" * 5), (3, "a/b/c/x.py", "code"), (4, "d/y.py", ""), (5, "a/b/own.py", mit + "\nx\ny\nz\nw"), (9, "e/f/g", None), (10, "e/h", mit),
        (6, "z.py", None), (7, None, "code"), (8, "e/notice.txt", "nothing here"), (8, "e/notice.txt", "nothing here"),
    ]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, path string, text string, license string")
    found = scan_licences(docs, F.concat(F.lit("/repo/"), F.col("path")))
    got = {(r["doc_id"], r["license"], r["basis"], r["directory"]) for r in found.collect()}
    assert got == {
        (1, "MIT", "own", None), (2, "GPL-3.0", "own", None), (3, "GPL-3.0", "inherited", "/repo/a"), (4, "MIT", "inherited", "/repo"),
        (5, "MIT", "own", None), (6, "MIT", "inherited", "/repo"), (7, None, "none", None), (8, "MIT", "inherited", "/repo/e"), (9, "MIT", "inherited", "/repo/e"), (10, "MIT", "own", None),
    }
    assert found.count() == len(rows) and scan_licences(docs.limit(0), F.col("path")).count() == 0
