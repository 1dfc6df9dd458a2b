"""License scans: TF-IDF cosine of headers and licence files to templates, then inheritance from ancestor directories.

Everything is expressed in DataFrame functions. Lines, paragraphs and whole texts are vectors of terms, weighted by how
rare a term is among the templates. A path without a licence of its own takes that of the nearest directory above it that
has one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import few, save

# Statements, notices and clauses as licences have them, a paragraph each.
TEMPLATES = {
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "BSD-2-Clause": (
        "Use of this source code is governed by the BSD 2-Clause License.",
        "BSD 2-Clause License",
    ),
    "BSD-3-Clause": (
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Use of this source code is governed by the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "BSL-1.0": (
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
        "Boost Software License - Version 1.0 - August 17th, 2003",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC0-1.0": (
        "Dedicated to the public domain under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal Public Domain Dedication.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ),
    "ISC": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "LGPL-3.0": (
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "The MIT License (MIT)",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Mozilla Public License Version 2.0",
    ),
    "Proprietary": (
        "All rights reserved.",
        "Proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.",
        "No part may be copied or distributed without permission.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
}


def template_bodies(texts: dict[str, tuple[str, ...]] = TEMPLATES) -> list[tuple[str, str]]:
    """(license, body): each paragraph, all of them together as a licence file, and the SPDX line of the name."""
    return [(name, body) for name, parts in sorted(texts.items()) for body in dict.fromkeys((*parts, " ".join(parts), f"SPDX-License-Identifier: {name}"))]


def _terms(text: Column) -> Column:
    """Distinct runs of letters or digits in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != ""))


def template_vectors(spark: SparkSession, texts: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """Unit vectors of the templates (template, license, term, idf, weight); bounded by the templates given.

    A term weighs its inverse document frequency among the templates, however often it stands in one.
    """
    bodies = [(k, *x) for k, x in enumerate(template_bodies(texts))]
    rows = spark.createDataFrame(bodies, "template int, license string, body string")
    terms = rows.select("template", "license", F.explode(_terms(F.col("body"))).alias("term"))
    held = terms.groupBy("term").agg((F.ln(F.lit(1.0 + len(bodies)) / (1 + F.count(F.lit(1)))) + 1).alias("idf"))
    weighed = terms.join(F.broadcast(held), "term")
    norms = weighed.groupBy("template").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("norm"))
    return weighed.join(F.broadcast(norms), "template").select("template", "license", "term", "idf", (F.col("idf") / F.col("norm")).alias("weight"))


def _units(text: Column) -> Column:
    """Lines, paragraphs of more than one line, and the text if it has several paragraphs, as (body, whole)."""
    lines, paragraphs = F.split(text, "\n"), F.split(text, "\n[ \t\r]*\n")
    of_lines = F.transform(lines, lambda x: F.struct(x.alias("body"), (F.size(lines) == 1).alias("whole")))
    several = F.filter(paragraphs, lambda x: F.contains(x, F.lit("\n")))
    of_paragraphs = F.transform(several, lambda x: F.struct(x.alias("body"), (F.size(paragraphs) == 1).alias("whole")))
    of_text = F.when(F.size(paragraphs) > 1, F.array(F.struct(text.alias("body"), F.lit(True).alias("whole"))))
    return F.concat(of_lines, of_paragraphs, F.coalesce(of_text, F.array().cast("array<struct<body:string,whole:boolean>>")))


def licence_statements(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.6, texts: dict[str, tuple[str, ...]] = TEMPLATES
) -> DataFrame:
    """Statements found in whole texts: id, whole (it is the whole text), license, cosine, shared (terms in common).

    A row for each line, each paragraph and each text whose vector has a cosine of `least` or more to its best template;
    ties go to the first name. A term that no template has is the rarest. Units with too few terms of the templates for
    such a cosine are left out before terms are dealt out; that bound is exact. Units that read alike are scored
    once, as a statement may stand in a third of all texts; what is joined back to them is bounded by the sum of squares.
    """
    vectors = template_vectors(docs.sparkSession, texts)
    rare = math.log(1.0 + len(template_bodies(texts))) + 1
    idf = {r["term"]: r["idf"] for r in vectors.select("term", "idf").distinct().collect()}  # of the templates alone
    units = docs.select(F.col(id_col).alias("id"), F.explode(_units(F.col(text_col))).alias("unit")).select("id", "unit.*")
    # Of a vector with n terms, k of them of the templates, the cosine is sqrt(k / n) at most, as other terms weigh more.
    units = units.withColumn("terms", _terms(F.col("body"))).withColumn("known", F.filter("terms", lambda t: t.isin(*idf)))
    units = units.where((F.size("known") > 0) & (F.size("known") >= least * least * F.size("terms")))
    units = save(units.select("id", "whole", "body", "terms"), "units")
    bodies = units.groupBy("body").agg(F.first("terms").alias("terms")).select("body", F.explode("terms").alias("term"))
    weights = F.broadcast(vectors.select("term", "idf").distinct())
    weighed = bodies.join(weights, "term", "left").withColumn("w", F.coalesce("idf", F.lit(rare))).drop("idf")
    norms = weighed.groupBy("body").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    near = weighed.join(F.broadcast(vectors.select("template", "license", "term", "weight")), "term")
    dots = near.groupBy("body", "template", "license").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"), F.count(F.lit(1)).alias("shared"))
    scored = dots.join(norms, "body").withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("cosine") >= least)
    best = scored.groupBy("body").agg(F.min(F.struct((-F.col("cosine")).alias("least"), "license", (-F.col("shared")).alias("most"))).alias("best"))
    best = best.select("body", F.col("best.license").alias("license"), (-F.col("best.least")).alias("cosine"), (-F.col("best.most")).alias("shared"))
    return units.join(few(save(best, "scored")), "body").select("id", "whole", "license", "cosine", "shared")


def scan_licences(
    docs: DataFrame,
    path: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: float = 0.6,
    file_name: str = r"(?i)^(licen[cs]e|copying|notice)",
) -> DataFrame:
    """One row per row of `docs`: id, license, cosine, basis, directory.

    A row with a statement has its best one (basis ``own``; most shared terms, then the highest cosine, then the first
    name). It is a licence file if its file name matches `file_name` or its whole text is a statement. Other rows take
    the licence of the nearest directory above them, their own included, that has a licence file (basis ``inherited``);
    if there is none, license, cosine and directory are null (basis ``none``). Null and empty texts have no statement, a
    null path has no directory. Rows that repeat an id share the statements of all of them; other columns are not looked at.
    """
    placed = docs.select(F.col(id_col).alias("id"), path.alias("path"))
    placed = placed.select("id", F.element_at(F.split("path", "/"), -1).alias("name"), F.regexp_replace("path", "/?[^/]*$", "").alias("folder"))
    first = F.min(F.struct((-F.col("shared")).alias("most"), (-F.col("cosine")).alias("least"), "license")).alias("best")
    own = save(licence_statements(docs, id_col, text_col, least).groupBy("id").agg(first, F.max("whole").alias("whole")), "statements")
    own = own.select("id", F.col("best.license").alias("license"), (-F.col("best.least")).alias("cosine"), (-F.col("best.most")).alias("shared"), "whole")
    rows = placed.join(own, placed["id"].eqNullSafe(own["id"]), "left").select(placed["*"], "license", "cosine", "shared", "whole")
    is_file = F.col("license").isNotNull() & (F.col("name").rlike(file_name) | F.col("whole"))
    files = rows.where(is_file & F.col("folder").isNotNull()).groupBy("folder").agg(first)
    given = files.select(F.col("folder").alias("directory"), F.col("best.license").alias("given"), (-F.col("best.least")).alias("near"))
    parts = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda k: F.struct(k.alias("depth"), F.concat_ws("/", F.slice("parts", 1, k)).alias("directory")))
    folders = placed.where("folder IS NOT NULL").select("folder").distinct().withColumn("parts", parts)
    steps = folders.select("folder", F.inline(above))
    nearest = steps.join(few(save(given, "given")), "directory").groupBy("folder").agg(F.max_by(F.struct("directory", "given", "near"), "depth").alias("up"))
    joined = rows.join(few(save(nearest, "nearest")), "folder", "left")
    stated = F.col("license").isNotNull()
    return joined.select(
        F.col("id").alias(id_col),
        F.coalesce("license", "up.given").alias("license"),
        F.coalesce("cosine", "up.near").alias("cosine"),
        F.when(stated, "own").when(F.col("up").isNotNull(), "inherited").otherwise("none").alias("basis"),
        F.when(~stated, F.col("up.directory")).alias("directory"),
    )
