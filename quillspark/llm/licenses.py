"""Licence scan: Dice coefficient over word bigrams against licence templates.

Each line, each paragraph of several lines, and each text of several paragraphs as a whole is
compared with all templates: notices, and whole licence texts (users add their own by ``items``).
Text is normalised to lower-case ASCII words. The coefficient counts repeated bigrams as often as
they occur on both sides: ``2 * shared / (bigrams of segment + bigrams of template)``. For a
threshold t only templates of between t/(2-t) and (2-t)/t times the segment's bigrams can
reach it; segments outside all templates' bounds are dropped before any bigram is made, and
the bound is part of the join with the templates' bigrams. Only DataFrame functions are used.

Scale: the join's small side is the template table, whose size is fixed by the template list
(checked against ``max_template_bigrams``); rows that survive it are pre-aggregated before
the one shuffle, whose key holds document, segment and template.

Contract: null and empty texts match nothing; repeated documents are reported for each row
(told apart by ``row``), null ids as null; only a segment's number of words decides whether it is
too long or too short for a template; other columns are ignored, whatever their names; an empty
table gives no rows.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAMES = {
    "MIT": ("MIT License",),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0"),
    "GPL-2.0": ("GNU General Public License, version 2", "GPLv2 License"),
    "GPL-3.0": ("GNU General Public License, version 3", "GPLv3 License"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3",),
    "AGPL-3.0": ("GNU Affero General Public License, version 3",),
    "BSD-2-Clause": ("BSD 2-Clause License",),
    "BSD-3-Clause": ("BSD 3-Clause License",),
    "MPL-2.0": ("Mozilla Public License, version 2.0",),
    "ISC": ("ISC License",),
    "Unlicense": ("Unlicense License",),
    "CC0-1.0": ("CC0 1.0 Universal",),
    "CC-BY-4.0": ("CC BY 4.0",),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0",),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0",),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0",),
}
FORMS = ("Released under the {}.", "Licensed under the {}.", "Licensed under {}.", "This work is licensed under the {}.", "This work is licensed under {}.", "This project is licensed under the terms of the {}.")
TEXTS = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}


# The wording of short licences from their first condition on.
_MIT = TEXTS["MIT"] + " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC_END = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD = TEXTS["BSD-3-Clause"] + " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAME = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
WHOLE_TEXTS = {"MIT": f"{_MIT} {_AS_IS}", "ISC": f"{TEXTS['ISC']} {_ISC_END}", "BSD-2-Clause": _BSD + _BSD_END, "BSD-3-Clause": _BSD + _BSD_NAME + _BSD_END}


def templates() -> list[tuple[str, str, str]]:
    """(template, licence, text) of all templates: each name in each form, and the longer texts."""
    made = [(f"{licence}/{i}.{j}", licence, form.format(name)) for licence, names in NAMES.items() for i, name in enumerate(names) for j, form in enumerate(FORMS)]
    return made + [(f"{licence}/{kind}", licence, text) for kind, texts in (("text", TEXTS), ("whole", WHOLE_TEXTS)) for licence, text in texts.items()]


def words_of(text: str) -> list[str]:
    """The same normalisation as the DataFrame's, for templates."""
    return "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in text.lower()).split()


def template_bigrams(items: list[tuple[str, str, str]]) -> list[tuple[str, str, str, int, int]]:
    """(template, licence, bigram, count, bigrams of the template) for each distinct bigram."""
    rows = []
    for template, licence, text in items:
        words = words_of(text)
        counts = Counter(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))
        rows += [(template, licence, bigram, n, len(words) - 1) for bigram, n in counts.items()]
    return rows


def scan(docs: DataFrame, threshold: float = 0.8, items: list[tuple[str, str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text", max_template_bigrams: int = 100_000) -> DataFrame:
    """Segments that resemble a licence: ``doc_id, kind, segment, licence, template, shared, dice``.

    ``kind`` is ``line``, ``paragraph`` or ``text`` and ``segment`` its number in the text from 0. Of
    a licence's templates the one with the highest coefficient stands, of equals the first
    by name.
    """
    spark = docs.sparkSession
    rows = template_bigrams(items if items is not None else templates())
    if not rows or len(rows) > max_template_bigrams:
        raise ValueError(f"{len(rows)} template bigrams; between 1 and {max_template_bigrams} can be joined in memory")
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    small = F.broadcast(spark.createDataFrame(rows, "template string, licence string, bigram string, of long, t_size long"))
    least, most = min(r[4] for r in rows) * low, max(r[4] for r in rows) * high

    texts = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text")).where("text is not null")
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(F.lit("line").alias("kind"), i.alias("segment"), x.alias("body")))
    parts = F.transform(F.split("text", "\n[ \t\r]*\n"), lambda x, i: F.struct(F.lit("paragraph").alias("kind"), i.alias("segment"), x.alias("body")))
    several = F.filter(parts, lambda x: F.contains(x["body"], F.lit("\n")))
    whole = F.when(F.size(parts) > 1, F.array(F.struct(F.lit("text").alias("kind"), F.lit(0).alias("segment"), F.col("text").alias("body")))).otherwise(F.slice(lines, 1, 0))
    segments = (
        texts.select("doc_id", "row", F.explode(F.concat(lines, several, whole)).alias("s"))
        .select("doc_id", "row", "s.kind", "s.segment", F.trim(F.regexp_replace(F.lower("s.body"), "[^a-z0-9]+", " ")).alias("body"))
        .withColumn("words", F.split("body", " "))
        .withColumn("size", F.size("words").cast("long") - 1)
        .where(F.col("size").between(int(least), int(most)) & (F.col("size") >= 1))
    )
    bigrams = F.transform(F.slice("words", 1, F.col("size").cast("int")), lambda w, i: F.concat(w, F.lit(" "), F.element_at("words", i + 2)))
    hits = (
        segments.select("doc_id", "row", "kind", "segment", "size", F.explode(bigrams).alias("bigram"))
        .join(small, "bigram")
        .where((F.col("size") >= F.col("t_size") * low) & (F.col("size") <= F.col("t_size") * high))
        .groupBy("doc_id", "row", "kind", "segment", "size", "template", "licence", "t_size", "bigram", "of")
        .agg(F.count("*").alias("n"))
        .groupBy("doc_id", "row", "kind", "segment", "size", "template", "licence", "t_size")
        .agg(F.sum(F.least("n", "of")).alias("shared"))
        .withColumn("dice", F.lit(2.0) * F.col("shared") / (F.col("size") + F.col("t_size")))
        .where(F.col("dice") >= threshold)
    )
    first = F.struct((-F.col("dice")).alias("d"), "template", "shared", "dice")
    return (
        hits.groupBy("doc_id", "row", "kind", "segment", "licence")
        .agg(F.min(first).alias("m"))
        .select("doc_id", "row", "kind", "segment", "licence", "m.template", "m.shared", "m.dice")
    )


def oracle_sql(threshold: float = 0.8) -> str:
    """DuckDB SQL for the rows of the query over ``documents``."""
    rows = template_bigrams(templates())
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    values = ", ".join("('{}', '{}', '{}', {}, {})".format(*r) for r in rows)
    return f"""
WITH t(template, licence, bigram, f, t_size) AS (VALUES {values}),
lines AS (SELECT doc_id, 'line' AS kind, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS segment FROM documents WHERE text IS NOT NULL),
paras AS (SELECT doc_id, 'paragraph' AS kind, unnest(string_split_regex(text, '\\n[ \\t\\r]*\\n')) AS body, generate_subscripts(string_split_regex(text, '\\n[ \\t\\r]*\\n'), 1) - 1 AS segment FROM documents WHERE text IS NOT NULL),
wholes AS (SELECT doc_id, 'text' AS kind, text AS body, 0 AS segment FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '\\n[ \\t\\r]*\\n')),
segments AS (SELECT *, string_split(trim(regexp_replace(lower(body), '[^a-z0-9]+', ' ', 'g')), ' ') AS words FROM (SELECT * FROM lines UNION ALL SELECT * FROM paras WHERE contains(body, chr(10)) UNION ALL SELECT * FROM wholes)),
grams AS (SELECT doc_id, kind, segment, len(words) - 1 AS size, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS bigram FROM segments WHERE len(words) BETWEEN 2 AND 2000),
hits AS (SELECT doc_id, kind, segment, size, template, licence, t_size, bigram, f, count(*) AS n FROM grams JOIN t USING (bigram) WHERE size >= t_size * CAST({low!r} AS DOUBLE) AND size <= t_size * CAST({high!r} AS DOUBLE) GROUP BY ALL),
dice AS (SELECT doc_id, kind, segment, template, licence, sum(least(n, f)) AS shared, 2.0 * sum(least(n, f)) / (size + t_size) AS dice FROM hits GROUP BY doc_id, kind, segment, size, template, licence, t_size)
SELECT doc_id, kind, CAST(segment AS INTEGER) AS segment, licence, template, CAST(shared AS BIGINT) AS shared, CAST(dice AS DOUBLE) AS dice FROM dice WHERE dice >= {threshold}
QUALIFY row_number() OVER (PARTITION BY doc_id, kind, segment, licence ORDER BY dice DESC, template) = 1"""
