"""Licence scans by canonical digests.

A unit of text, the whole document, one of its paragraphs or one of its lines,
is brought to a canonical form: lower case, no copyright lines, one spelling for
words and phrases that mean the same, no punctuation, single spaces.  The lines
of a document or paragraph are joined first, so spellings may cross lines, and
of these only true copyright lines go, not a wrapped line of a licence that
begins with the word.  The SHA-256 of this form is joined to the digests of
known licence texts made the same way: ``KNOWN``, the short licences with their
usual titles, and the files of ``license_texts`` with and without title and
appendix.  Only entire units match, never parts.

Most units need no canonical form: it begins with the unit's own first word,
unless that word begins a spelling or is a version, so a unit whose first word
is none of these and begins no known text can't be one.

All is DataFrame functions; the table of known digests is fixed and small, so
it is broadcast.  Matches are few and are joined back by id and text digest.

Defined cases: a null or empty text has no match; repeated rows give repeated
results; a null id is matched by its text; an empty table gives no row; extra
columns are not read.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# FIXED VALUES — licence notices and texts by SPDX id
KNOWN = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
            "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
            "notice and this permission notice shall be included in all copies or substantial portions of the Software. THE "
            "SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
            "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS "
            "OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
            "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "This work is licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
                   "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                   "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
                   "See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Released under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
            "PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
            "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
            "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN "
            "AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
            "PERFORMANCE OF THIS SOFTWARE."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
]
# FIXED VALUES — short licences as whole texts, and their titles
BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
BSD_ITEMS = [
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission."]
BSD_TAIL = (" THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
            "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
            "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
            "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
            "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
            "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
    "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any "
    "means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in "
    "the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and "
    "successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software "
    "under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
MORE = "For more information, please refer to <{}>"
TITLES = {"MIT": ["MIT License", "The MIT License", "MIT License (MIT)", "The MIT License (MIT)"], "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
          "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "BSD License"], "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License"],
          "Unlicense": ["The Unlicense", "Unlicense"]}
TEXTS = Path(__file__).parent / "license_texts"
# FIXED VALUES — spellings, after punctuation has gone, and what stands for them
SPELLINGS = [
    ("gnu general public license", "gpl"), ("gnu gpl", "gpl"), ("creative commons", "cc"), ("attribution", "by"),
    ("noncommercial", "nc"), ("non commercial", "nc"), ("sharealike", "sa"), ("share alike", "sa"), ("international license", "license"),
    ("unported license", "license"), ("distributed under", "licensed under"), ("released under", "licensed under"),
    ("available under", "licensed under"), ("terms of the", "the"), ("the the", "the"), ("sub license", "sublicense"),
    ("non infringement", "noninfringement"), ("merchantibility", "merchantability"), ("copyright owner", "copyright holder"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COPYRIGHT_LINE = r"^[^a-z0-9(©]*(copyright|\(c\)|©|all rights reserved).*$"


#: Lines of a longer text that are copyright lines; a licence's own wrapped lines may begin with these words too.
TRUE_COPYRIGHT = (r"^[^A-Za-z0-9(©]*(([Cc]opyright|COPYRIGHT)([\s:,-]*(\([cC]\)|©|[0-9]{4}|[<\[{]|by\b|(?!(Licen[cs]e|Holder|Notice|Owner|Law)s?\b)[A-Z][a-z])|$)"
                  r"|\([cC]\)[^A-Za-z]*[0-9]{4}|\([cC]\) [Cc]opyright|©|[Aa][Ll][Ll] [Rr]ights [Rr]eserved\W*$)")
BLANK = r"\n[^A-Za-z0-9\n]*\n"
#: Lines whose canonical form is empty, before they are lower-cased; first words that are versions.
EMPTY = r"^([^A-Za-z0-9]*$|[^A-Za-z0-9(©]*((?i:copyright|\(c\)|all rights reserved)|©).*$)"
VERSION = r"^v(ersion)?([0-9]|$)"


def canonical(line: Column) -> Column:
    """The canonical form of one line."""
    c = F.replace(F.translate(line, UPPER, LOWER), F.lit("licenc"), F.lit("licens"))
    c = F.regexp_replace(c, COPYRIGHT_LINE, "")
    c = F.regexp_replace(c, r"[^a-z0-9]+", " ")
    c = F.regexp_replace(c, r"\bv(ersion)? ?([0-9])", "$2")
    c = F.concat(F.lit(" "), F.trim(c), F.lit(" "))
    for old, new in SPELLINGS:
        c = F.replace(c, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(c)


def joined(lines: Column) -> Column:
    """Lines that are one text, as one line without copyright lines."""
    return F.array_join(F.filter(lines, lambda c: ~F.rlike(F.trim(c), F.lit(TRUE_COPYRIGHT))), " ")


def texts() -> list[tuple[str, str]]:
    """The known notices and whole licences, each on one line without copyright lines."""
    short = [(n, t) for n, t in KNOWN if n in ("MIT", "ISC") and t.startswith("Permission")]
    for n, items in (("BSD-3-Clause", BSD_ITEMS), ("BSD-2-Clause", BSD_ITEMS[:2])):
        short.append((n, BSD_HEAD + " ".join(items) + BSD_TAIL))
        short.append((n, BSD_HEAD + " ".join(f"{i}. {t}" for i, t in enumerate(items, 1)) + BSD_TAIL))
    short += [("Unlicense", UNLICENSE)] + [("Unlicense", f"{UNLICENSE} {MORE.format(u)}") for u in (
        "https://unlicense.org", "https://unlicense.org/", "http://unlicense.org", "http://unlicense.org/")]
    out = KNOWN + short + [(n, f"{title} {t}") for n, t in short for title in TITLES[n]]
    drop = re.compile(TRUE_COPYRIGHT)
    for path in sorted(TEXTS.glob("*.txt")):
        whole = path.read_text(encoding="utf-8").strip()
        end = re.search(r"END OF TERMS AND CONDITIONS", whole)
        for text in [whole] + ([whole[:end.end()], whole[:end.start()]] if end else []):
            for part in (text, re.split(BLANK, text, maxsplit=1)[1]):  # the first paragraph is the title
                out.append((path.stem, " ".join(x.strip() for x in part.split("\n") if not drop.search(x.strip()))))
    return out


def known(spark) -> DataFrame:
    """Digest and SPDX id of the known texts."""
    rows = spark.createDataFrame(texts(), "spdx string, notice string")
    return rows.select(F.sha2(canonical(F.col("notice")).cast("binary"), 256).alias("digest"), "spdx").distinct()


def opening_words(spark) -> list[str]:
    """First words of the known texts' canonical forms, and of the spellings that are replaced."""
    forms = spark.createDataFrame(texts(), "spdx string, notice string").select(canonical(F.col("notice")).alias("form"))
    known_first = [r[0] for r in forms.select(F.substring_index("form", " ", 1)).distinct().collect()]  # of a fixed table
    return sorted({*known_first, *(old.split()[0] for old, _ in SPELLINGS)})


def possible(unit: Column, words: list[str]) -> Column:
    """Whether the canonical form of a unit without copyright lines can be a known one, by its first word."""
    first = F.replace(F.translate(F.regexp_extract(unit, "[A-Za-z0-9]+", 0), UPPER, LOWER), F.lit("licenc"), F.lit("licens"))
    return first.isin(*words) | F.rlike(first, F.lit(VERSION))


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, licenses, n_lines, whole`` of each document: the ids of the licences whose text is a line, a
    paragraph or the whole of it, in order and joined by commas, the number of such lines, and whether the whole document is one."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    words = opening_words(docs.sparkSession)
    cut = rows.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("own"), F.split("text", "\n").alias("lines"),
                      F.filter(F.split("text", BLANK), lambda c: F.contains(F.trim(c), F.lit("\n"))).alias("paragraphs"))
    raw = cut.select("doc_id", "own", "lines", joined(F.col("lines")).alias("all"), F.filter("lines", lambda c: ~F.rlike(c, F.lit(EMPTY))).alias("filled"),
                     F.transform("paragraphs", lambda c: joined(F.split(c, "\n"))).alias("paragraphs"))
    able = lambda c: possible(c, words)
    by_line = F.array_join(F.filter(F.transform("filled", canonical), lambda c: c != ""), " ")
    lines = raw.select("doc_id", "own", F.transform(F.filter("lines", able), canonical).alias("lines"), F.transform(F.filter("paragraphs", able), canonical).alias("paragraphs"),
                       F.when(able(F.col("all")), canonical(F.col("all"))).alias("all"),
                       F.when(able(F.try_element_at("filled", F.lit(1))), by_line).alias("whole"))
    unit = lambda kind: lambda c: F.struct(F.lit(kind).alias("kind"), c.alias("form"))
    units = lines.select("doc_id", "own", F.explode(F.concat(
        F.transform(F.filter(F.array("whole", "all"), F.isnotnull), unit("whole")), F.transform("paragraphs", unit("paragraph")), F.transform("lines", unit("line")))).alias("u"))
    hits = units.select("doc_id", "own", "u.kind", F.sha2(F.col("u.form").cast("binary"), 256).alias("digest")) \
        .join(F.broadcast(known(docs.sparkSession)), "digest")
    # rows with the same id and text have the same hits, as often as there are such rows
    found = hits.groupBy(F.col("doc_id").alias("_id"), F.col("own").alias("_own")).agg(
        F.array_join(F.array_sort(F.collect_set("spdx")), ",").alias("licenses"),
        F.count_if(F.col("kind") == "line").alias("lines"), F.max(F.col("kind") == "whole").alias("whole"))
    copies = rows.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("own"))
    times = copies.groupBy(F.col("doc_id").alias("_i"), F.col("own").alias("_o")).agg(F.count(F.lit(1)).alias("times"))
    found = found.join(times, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_own") == F.col("_o")))
    out = copies.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("own") == F.col("_own")), "left")
    return out.select("doc_id", F.coalesce("licenses", F.lit("")).alias("licenses"),
                      F.coalesce(F.expr("lines div times"), F.lit(0)).cast("long").alias("n_lines"), F.coalesce("whole", F.lit(False)).alias("whole"))


def _canonical_sql(line: str) -> str:
    c = f"replace(translate({line}, '{UPPER}', '{LOWER}'), 'licenc', 'licens')"
    c = f"regexp_replace({c}, '{COPYRIGHT_LINE}', '')"
    c = f"regexp_replace({c}, '[^a-z0-9]+', ' ', 'g')"
    c = rf"regexp_replace({c}, '\bv(ersion)? ?([0-9])', '\2', 'g')"
    c = f"(' ' || trim({c}) || ' ')"
    for old, new in SPELLINGS:
        c = f"replace({c}, ' {old} ', ' {new} ')"
    return f"trim({c})"


def sql() -> str:
    """The same by SQL for notices of ``KNOWN`` that don't cross lines, over a view ``documents`` whose ids are unique."""
    values = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in KNOWN)
    return f"""
with k as (select distinct sha256({_canonical_sql('notice')}) as digest, spdx from (values {values}) as t(spdx, notice)),
l as (select doc_id, unnest(range(1, len(x) + 1)) as n, unnest(x) as line from (select doc_id, string_split(coalesce(text, ''), chr(10)) as x from documents)),
c as (select doc_id, n, {_canonical_sql('line')} as form from l),
u as (select doc_id, false as whole, form from c
      union all select doc_id, true, trim(coalesce(string_agg(form, ' ' order by n) filter (where form <> ''), '')) from c group by doc_id),
h as (select doc_id, whole, spdx from u join k on sha256(form) = digest),
f as (select doc_id, array_to_string(list_sort(list(distinct spdx)), ',') as licenses, count(*) filter (where not whole) as n_lines,
      bool_or(whole) as whole from h group by doc_id)
select d.doc_id, coalesce(licenses, '') as licenses, coalesce(n_lines, 0)::bigint as n_lines, coalesce(whole, false) as whole
from documents d left join f using (doc_id)
"""
