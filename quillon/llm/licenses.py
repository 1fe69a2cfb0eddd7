"""Operator 2: licence scan by canonical digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whole licence texts, as published by their stewards.
LICENSES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "MIT (notice)": "Released under the MIT License.",
    "Apache-2.0 (notice)": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 (notice)": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-4.0 (notice)": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 (notice)": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0 (notice)": "Licensed under CC BY-NC 4.0.",
    "Reserved (notice)": "All rights reserved.",
}

#: Title lines that stand above a whole licence in its file.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "BSD 0-Clause License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License'],
    "Zlib": ["zlib License", "The zlib License", "The zlib/libpng License"],
}

#: Spellings that count as the same word.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "sub license": "sublicense", "acknowledgement": "acknowledgment",
    "non commercial": "noncommercial", "per cent": "percent", "copyright owner": "copyright holder", "copyright owners": "copyright holders",
    "organisation": "organization", "judgement": "judgment", "merchantibility": "merchantability", "https": "http", "ver": "version",
}

#: A folded line that only says who holds the copyright.
OWNER_LINE = r"^(copyright c [0-9]|copyright [0-9]{4}|copyright c [a-z]|c copyright |c [0-9]{4} )"
NOT_WORD = r"[^\p{L}\p{N}\n]+"


def spelled(text: Column) -> Column:
    for old, new in SPELLINGS.items():
        text = F.replace(text, F.lit(f" {old} "), F.lit(f" {new} "))
    return text


def folded_lines(text: Column) -> Column:
    """The lines with a word, in lower case, other than letters and digits as one space, in one spelling."""
    text = F.replace(F.replace(F.lower(text), F.lit("©"), F.lit(" c ")), F.lit("\n"), F.lit(" \n "))
    text = spelled(F.concat(F.lit(" "), F.regexp_replace(text, NOT_WORD, " "), F.lit(" ")))
    return F.array_remove(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), "")


def folded(lines: Column) -> Column:
    """Folded lines as one text, without those that say who holds the copyright."""
    return F.trim(spelled(F.concat(F.lit(" "), F.array_join(F.filter(lines, lambda x: ~x.rlike(OWNER_LINE)), " "), F.lit(" "))))


def known_digests(spark: SparkSession, licenses: dict[str, str], titles: dict[str, list[str]] = TITLES) -> DataFrame:
    """canonical_sha256 and license_id of each known text, and of it below each of its titles; of texts that fold to one, the first id."""
    texts = [(k, x) for k, v in sorted(licenses.items()) for x in (v, *(f"{t}\n{v}" for t in titles.get(k, ())))]
    rows = F.array(*(F.struct(F.lit(k).alias("license_id"), F.lit(x).alias("_text")) for k, x in texts))
    known = spark.range(1).select(F.inline(rows)).withColumn("_lines", folded_lines(F.col("_text")))
    known = known.select("license_id", F.sha2(folded(F.col("_lines")), 256).alias("canonical_sha256"))
    return known.groupBy("canonical_sha256").agg(F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, text: str = "text", licenses: dict[str, str] = LICENSES, max_known: int = 100_000) -> DataFrame:
    """Operator 2: ``docs`` with canonical_sha256, license_id and notices.

    license_id: the known licence that the entire text is, after folding case, punctuation,
    copyright lines and spellings, with or without one of its title lines; else null. notices: sorted ids of the known texts that whole
    lines are, for licence lines inside other texts. The known digests are broadcast; more than
    ``max_known`` are refused. Of known texts that fold to one, the first id is given. Null and empty texts have the digest of nothing and no licence.
    Repeated rows are scanned alike; an empty table gives an empty table. Columns of ``docs``
    with a name of the result are replaced.
    """
    if len(licenses) > max_known:
        raise ValueError(f"{len(licenses)} known licences; at most {max_known} are broadcast")
    known = known_digests(docs.sparkSession, licenses)
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    df = docs.drop("canonical_sha256", "license_id", "notices").withColumn("_lines", folded_lines(whole))
    df = df.withColumn("canonical_sha256", F.sha2(folded(F.col("_lines")), 256))
    df = df.join(F.broadcast(known), "canonical_sha256", "left")
    # a line is judged by itself: known texts of one line, by the digest of the folded line
    single = [k for k, v in sorted(licenses.items()) if "\n" not in v]
    digests = docs.sparkSession.range(1).select(F.array(*(F.sha2(F.array_join(folded_lines(F.lit(licenses[k])), " "), 256) for k in single)).cast("array<string>")).first()[0]
    ids = dict(zip(reversed(digests), reversed(single), strict=True))  # of texts that fold to one, the first id
    by_digest = F.create_map(*(F.lit(x) for pair in ids.items() for x in pair)) if ids else F.create_map().cast("map<string,string>")
    found = F.array_compact(F.transform("_lines", lambda x: F.try_element_at(by_digest, F.sha2(x, 256))))
    return df.withColumn("notices", F.array_sort(F.array_distinct(found))).drop("_lines")


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _spelled_sql(text: str) -> str:
    for old, new in SPELLINGS.items():
        text = f"replace({text}, ' {old} ', ' {new} ')"
    return text


def _lines_sql(text: str) -> str:
    text = f"replace(replace(lower({text}), '©', ' c '), chr(10), ' ' || chr(10) || ' ')"
    text = _spelled_sql(f"' ' || regexp_replace({text}, '{NOT_WORD}', ' ', 'g') || ' '")
    return f"list_filter(list_transform(string_split({text}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"


def _folded_sql(lines: str) -> str:
    return "trim(" + _spelled_sql(f"' ' || array_to_string(list_filter({lines}, lambda x: NOT regexp_matches(x, '{OWNER_LINE}')), ' ') || ' '") + ")"


def scan_sql(licenses: dict[str, str] = LICENSES) -> str:
    values = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in sorted(licenses.items()))
    return f"""
WITH known AS (SELECT license_id, sha256({_folded_sql("l")}) AS whole, CASE WHEN contains(t, chr(10)) THEN NULL ELSE sha256(array_to_string(l, ' ')) END AS line
               FROM (SELECT license_id, t, {_lines_sql("t")} AS l FROM (VALUES {values}) AS k(license_id, t))),
folded AS (SELECT doc_id, {_lines_sql("coalesce(text, '')")} AS l FROM documents),
found AS (SELECT doc_id, array_to_string(list_sort(list(DISTINCT license_id)), '; ') AS notices
          FROM (SELECT doc_id, sha256(unnest(l)) AS line FROM folded) JOIN known USING (line) GROUP BY doc_id)
SELECT d.doc_id, d.canonical_sha256, k.license_id, coalesce(f.notices, '') AS notices
FROM (SELECT doc_id, sha256({_folded_sql("l")}) AS canonical_sha256 FROM folded) d
LEFT JOIN known k ON k.whole = d.canonical_sha256 LEFT JOIN found f ON f.doc_id = d.doc_id"""
