"""License scan by canonical digests, in DataFrame functions only.

A text is brought into a canonical form: copyright lines are left out, A-Z becomes lower case,
equivalent spellings become one, and everything but letters and digits becomes a single space.
Its SHA-256 digest is joined with the digests of the known licences and notices. The same lookup
is made for each line of a text, which finds a notice inside a document.

Defined results: null, empty and wordless texts have the digest of the empty form and match
nothing; repeated rows match alike; several known licences of equal form are named together, in
alphabetical order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most known licences; they are broadcast, and a part of the plan.
MOST_KNOWN = 5_000

#: Spellings that licence texts use alike.
SPELLINGS = (
    ("licence", "license"), ("sub license", "sublicense"), ("sub licence", "sublicense"), ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"), ("authorise", "authorize"), ("calibre", "caliber"), ("cancelled", "canceled"),
    ("favour", "favor"), ("fulfil ", "fulfill "), ("initialise", "initialize"), ("judgement", "judgment"),
    ("labour", "labor"), ("non commercial", "noncommercial"),
    ("organisation", "organization"), ("per cent", "percent"), ("practise", "practice"), ("programme", "program"),
    ("realise", "realize"), ("recognise", "recognize"), ("utilisation", "utilization"), ("whilst", "while"),
    ("wilful", "willful"), ("https", "http"),
)

#: Two public licence texts and usual notices, without their copyright lines.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
)

#: Whole licence texts, a file each.
TEXTS = Path(__file__).parent / "license_texts"

#: Title lines that short licence texts come with.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "BSD 0-Clause License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License", "BSD 2-Clause \"Simplified\" License", "BSD License"),
    "BSD-3-Clause": (
        "BSD 3-Clause License", "The 3-Clause BSD License", "BSD 3-Clause \"New\" or \"Revised\" License", "BSD License",
    ),
    "Unlicense": ("The Unlicense", "Unlicense"),
    "Zlib": ("zlib License", "The zlib License"),
}


def _variants(name: str, text: str) -> Iterator[str]:
    """The usual variants of a licence's whole text."""
    forms = [text]
    if name.startswith("BSD-"):
        forms += [x.replace("THE COPYRIGHT HOLDER OR", "THE COPYRIGHT OWNER OR") for x in forms]
        forms += [re.sub(r"(?m)^\d\. ", "* ", x) for x in forms]
    if "END OF TERMS AND CONDITIONS" in text:  # the appendix on how to apply it is often left out
        terms, mark, _ = text.partition("END OF TERMS AND CONDITIONS")
        forms += [terms + mark, terms]
    for form in forms:
        yield form
        yield from (f"{title}\n\n{form}" for title in TITLES.get(name, ()))


def _whole_texts() -> Iterator[tuple[str, str]]:
    short = [(name, text) for name, text in NOTICES if name in TITLES and "AS IS" in text]
    files = [(p.stem, p.read_text(encoding="utf-8")) for p in sorted(TEXTS.glob("*.txt"))]
    for name, text in short + files:
        yield from ((name, form) for form in _variants(name, text))


#: All that is looked up: the notices, and the whole texts with and without title lines.
KNOWN = NOTICES + tuple(x for x in _whole_texts() if x not in NOTICES)

_COPYRIGHT_LINE = "(^|\n)[ \t]*(copyright|\\(c\\)|©|all rights reserved)[^\n]*"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical(text: Column) -> Column:
    """The canonical form of a text."""
    form = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    form = F.regexp_replace(form, _COPYRIGHT_LINE, "$1")
    form = F.regexp_replace(form, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F©“”‘’–—]+", " ")
    for spelling, one in SPELLINGS:
        form = F.replace(form, F.lit(spelling), F.lit(one))
    return F.trim(form)


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    """(digest, license): the digests to look up, each once; the list is small and bounded."""
    if len(known) > MOST_KNOWN:
        raise ValueError(f"More than {MOST_KNOWN} known licences")
    rows = spark.createDataFrame(list(known), "license string, text string")
    return (
        rows.select("license", canonical(F.col("text")).alias("form"))
        .where("form <> ''")
        .groupBy(F.sha2("form", 256).alias("digest"))
        .agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("license"))
    )


def scan_licenses(docs: DataFrame, known: DataFrame, name: str = "licenses", keep: list[str] | None = None) -> DataFrame:
    """Add a struct column: the text's digest, the licence it is as a whole, and those of its lines."""
    kept = [c for c in (docs.columns if keep is None else keep) if c != name]
    whole = F.broadcast(known.select(F.col("digest").alias("__digest"), F.col("license").alias("__whole")))
    pairs = [F.lit(x) for row in known.select("digest", "license").collect() for x in row]
    table = F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,string>")
    lines = F.split(F.col("__text"), "\n")
    named = F.transform(lines, lambda x: F.element_at(table, F.sha2(canonical(x), 256)))
    found = F.array_sort(F.array_distinct(F.filter(named, lambda x: x.isNotNull())))
    digested = docs.select(*kept, F.coalesce("text", F.lit("")).alias("__text")).withColumn(
        "__digest", F.sha2(canonical(F.col("__text")), 256)
    )
    return digested.join(whole, "__digest", "left").select(
        *kept,
        F.struct(
            F.col("__digest").alias("digest"),
            F.col("__whole").alias("whole_text"),
            found.alias("lines"),
        ).alias(name),
    )
