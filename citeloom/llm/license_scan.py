"""Licences by canonical digest: whole texts, and lines, looked up among digests of known texts.

A text is brought to one spelling (lower case; copyright lines out; British and joined spellings to one
form; all punctuation to single spaces) and hashed; equal digests are the same licence. Whole texts are looked up by
a hash join with a table of known digests: those of KNOWN, whose number this module fixes, and texts that the caller
gives. Lines are looked up among the former inside their row, so nothing is shuffled. A line is a copyright line only
if a year, (c), © or a placeholder follows the word: text that is wrapped before "copyright holders" stays.
DataFrame functions alone.

Null and empty texts have no licence; a line counts as often as it stands. Rows are judged alone: repeated rows, rows
without a doc_id and very long texts are no special case. Where one text is given for several licences, the first
license_id in order is taken. Other columns are left alone; an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: (pattern, replacement) in this order, on lower-case text: the same in Java's and RE2's syntax.
SPELLINGS = [
    (r"(?:^|\n)[ \t]*(?:copyright[ \t:]*(?:\(c\)|©|[0-9]{4}|[<\[{])|\(c\)[ \t]|©)[^\n]*", "\n"),
    (r"all rights reserved", ""),
    (r"licence", "license"),
    (r"licencing", "licensing"),
    (r"sub[ \n-]+licens", "sublicens"),
    (r"organis", "organiz"),
    (r"authoris", "authoriz"),
    (r"favour", "favor"),
    (r"non[ \n-]+commercial", "noncommercial"),
    (r"&", " and "),
    (r"https://", "http://"),
    (r"[^a-z0-9]+", " "),
]

#: SPDX identifier: names that notices use for it.
NAMES = {
    "MIT": ["MIT License", "MIT"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GPL-2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GPL-3.0"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPL-3.0"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPL-3.0"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL-2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "BSD-2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause License", "BSD-3-Clause"],
    "CC0-1.0": ["CC0 1.0 Universal", "CC0-1.0", "CC0 1.0"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "CC-BY-4.0"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "Unlicense": ["Unlicense"],
    "ISC": ["ISC License", "ISC"],
}
NOTICES = ["Released under the {}.", "Released under {}.", "Licensed under the {}.", "Licensed under {}.", "This work is licensed under the {}.", "This work is licensed under {}.", "This work is licensed under a {}.", "License: {}", "SPDX-License-Identifier: {}", "{}"]

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS"'
_FORMS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_CLAUSES = """1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_DISCLAIMED = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
#: Whole licence texts without their copyright lines, as published.
TEXTS = {
    "MIT": f"""MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

{_AS_IS}, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": f"""ISC License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

{_AS_IS} AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": f"""BSD Zero Clause License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

{_AS_IS} AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "BSD-2-Clause": f"""BSD 2-Clause License

{_FORMS}

{_CLAUSES}

{_DISCLAIMED}""",
    "BSD-3-Clause": f"""BSD 3-Clause License

{_FORMS}

{_CLAUSES}

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

{_DISCLAIMED}""",
    "Unlicense": f"""The Unlicense

This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

{_AS_IS}, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <http://unlicense.org/>""",
}
#: Titles that stand before these texts, besides their first lines.
TITLES = {"MIT": ["The MIT License", "The MIT License (MIT)"], "ISC": ["The ISC License"], "0BSD": ["Zero-Clause BSD"], "Zlib": ["zlib License", "The zlib/libpng License"], "BSD-2-Clause": ["Simplified BSD License", "The BSD 2-Clause License"], "BSD-3-Clause": ["New BSD License", "Modified BSD License", "The BSD 3-Clause License"], "Unlicense": []}
#: Licences whose first line is a title, not text.
TITLED = [k for k in TEXTS if k != "Zlib"]


def _variants(license_id: str, text: str) -> list[str]:
    """The text with and without title, numbers of its clauses, and Unlicense's last line."""
    title, body = text.split("\n\n", 1) if license_id in TITLED else ("", text)
    bodies = [body, re.sub(r"(?m)^[0-9]\. ", "", body)]
    if license_id == "Unlicense":
        bodies.append(body.rsplit("\n\n", 1)[0])
    return [f"{t}\n\n{b}" for t in ("", title, *TITLES[license_id]) for b in bodies]


_WHOLE = sorted({(k, t) for k, text in TEXTS.items() for t in _variants(k, text)})
_LINES = [(k, n.format(name)) for k, names in NAMES.items() for name in names for n in NOTICES]
KNOWN = [*_WHOLE, *_LINES]
#: Most letters, digits and blanks of a line that is a notice, and what a longer line must hold to be a whole text
#: in any of its spellings.
NOTICE, HINT = 2 * max(len(t) for _, t in _LINES), "(?i)permission|redistribution|unencumbered"


def canonical(text: Column) -> Column:
    out = F.lower(F.coalesce(text, F.lit("")))
    for pattern, to in SPELLINGS:
        out = F.regexp_replace(out, pattern, to)
    return F.trim(out)


def known_digests(spark: SparkSession, more: DataFrame | None = None) -> DataFrame:
    """digest, license_id: one row a digest, about as many as KNOWN, and those of more (license_id, text)."""
    known = spark.createDataFrame(KNOWN, "license_id string, text string")
    if more is not None:
        known = known.union(more.select(F.col("license_id").cast("string"), F.col("text").cast("string")).where("license_id is not null and trim(text) <> ''"))
    return known.select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "license_id").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def license_scan(docs: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """docs (doc_id, text): doc_id, text_digest, license_id of the whole text or null, n_license_lines,
    line_licenses (sorted, comma-joined, '' if none); one row a row of docs.

    more (license_id, text): further whole texts; they are joined, however many there are.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = known_digests(docs.sparkSession)  # fixed size
    by_digest = F.create_map(*(F.lit(x) for r in known.collect() for x in (r["digest"], r["license_id"])))
    whole = F.broadcast(known) if more is None else known_digests(docs.sparkSession, more)
    length = lambda x: F.length(F.trim(F.regexp_replace(x, "[^A-Za-z0-9]+", " ")))
    maybe = F.filter(F.split("text", "\n", -1), lambda x: (F.length(x) >= 2) & (x.rlike(HINT) | length(x).between(2, NOTICE)))
    found = F.filter(F.transform(maybe, lambda x: F.try_element_at(by_digest, F.sha2(canonical(x), 256))), lambda x: x.isNotNull())
    rows = docs.select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("text_digest"), found.alias("found"))
    out = rows.join(whole.withColumnRenamed("digest", "text_digest"), "text_digest", "left")
    return out.select("doc_id", "text_digest", "license_id", F.size("found").cast("long").alias("n_license_lines"), F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("line_licenses"))


def oracle_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def sql(column: str) -> str:
        out = f"lower(coalesce({column}, ''))"
        for pattern, to in SPELLINGS:
            out = f"regexp_replace({out}, {quote(pattern)}, {quote(to) if chr(10) not in to else 'chr(10)'}, 'g')"
        return f"trim({out})"

    values = ", ".join(f"({quote(k)}, {quote(t)})" for k, t in KNOWN)
    return f"""WITH given(license_id, text) AS (VALUES {values}),
known AS (SELECT sha256({sql("text")}) AS digest, min(license_id) AS license_id FROM given GROUP BY 1),
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
found AS (SELECT doc_id, license_id FROM (SELECT doc_id, sha256({sql("line")}) AS digest FROM lines) JOIN known USING (digest)),
summed AS (SELECT doc_id, count(*) AS n, array_to_string(list_sort(list_distinct(list(license_id))), ',') AS line_licenses FROM found GROUP BY doc_id),
whole AS (SELECT doc_id, sha256({sql("text")}) AS text_digest FROM documents)
SELECT w.doc_id, w.text_digest, k.license_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_license_lines, coalesce(s.line_licenses, '') AS line_licenses
FROM whole w LEFT JOIN known k ON w.text_digest = k.digest LEFT JOIN summed s ON w.doc_id = s.doc_id"""
