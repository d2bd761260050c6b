"""Licence scan by canonical digests (DataFrame functions only).

A text is put in canonical form: lower case, "copyright" lines dropped, equivalent spellings unified
(licence/license, web addresses with http or https, typographic quotes), everything that is not a letter or
digit turned into single blanks. Its md5 is hash-joined to the digests of known licence texts, canonicalised by the
same expressions. Two kinds of units are looked up, always as entire texts: the whole document and each line
of it (a line ends at a line feed or a carriage return). The licence table is a fixed catalogue (or the caller's own table). A line of another canonical length than all
of the fixed catalogue's is not in it and is not hashed.

Defined results: null and empty texts have no licence; repeated rows are reported separately; every known line counts, each licence is named once;
if two licences have one digest (a tie), the smallest name is reported; texts of any length are canonicalised whole; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.store import plain, stage

# Public short licence texts and header lines, by SPDX id.
KNOWN = [
    ("MIT", "header", "Released under the MIT License."),
    ("MIT", "header", "Licensed under the MIT License."),
    ("MIT", "header", "This project is licensed under the MIT License."),
    ("Apache-2.0", "header", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "header", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("GPL-3.0", "header", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "header", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "header", "Licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "header", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "header", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "header", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "header", "Licensed under CC0 1.0."),
    ("MPL-2.0", "header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "header", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "header", "Licensed under the BSD 2-Clause License."),
    (
        "MIT",
        "text",
        "MIT License\n\nCopyright (c) <year> <holders>\n\nPermission is hereby granted, free of charge, to any person obtaining a "
        'copy of this software and associated documentation files (the "Software"), to deal in the Software without '
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR '
        "IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "text",
        "ISC License\n\nCopyright (c) <year> <holders>\n\nPermission to use, copy, modify, and/or distribute this software for "
        "any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission "
        'notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO '
        "THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
        "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF "
        "USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "0BSD",
        "text",
        "Zero-Clause BSD\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n"
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "BSD-2-Clause",
        "text",
        "BSD 2-Clause License\n\nCopyright (c) <year>, <holders>\n\nRedistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT "
        'HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND '
        "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
        "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; "
        "OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
        "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "BSD-3-Clause",
        "text",
        "BSD 3-Clause License\n\nCopyright (c) <year>, <holders>\n\nRedistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n3. Neither the name of the copyright holder nor "
        "the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE '
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
        "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS "
        "OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
        "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH "
        "DAMAGE.",
    ),
    (
        "Zlib",
        "text",
        "zlib License\n\nCopyright (c) <year> <holders>\n\nThis software is provided 'as-is', without any express or implied warranty. In no event will the "
        "authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, "
        "including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software "
        "must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the "
        "product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be "
        "misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "Unlicense",
        "text",
        "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute "
        "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions "
        "that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We "
        "make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt "
        "act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT "
        "WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to "
        "<https://unlicense.org>",
    ),
    (
        "BSL-1.0",
        "text",
        "Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to any person or organization obtaining a copy "
        'of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the '
        "Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the "
        "following:\n\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following "
        "disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative "
        "works are solely in the form of machine-executable object code generated by a source language processor.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT "
        "WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND "
        "NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
]
# Equivalent spellings, applied in this order to lower-case text.
SPELLINGS = [("licence", "license"), ("https?://", ""), ("(?:\\(c\\)|©)", "c")]
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(?:copyright|\(c\)|\x{A9})[^\n]*(?:\n|$)"


def canonical_lines(text: Column) -> Column:
    """The canonical forms of a text's lines, still joined by line feeds; empty for null. ASCII case, so that every engine agrees."""
    out = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ\r", "abcdefghijklmnopqrstuvwxyz\n")
    out = F.regexp_replace(out, COPYRIGHT_LINE, "")
    for pattern, instead in SPELLINGS:
        out = F.regexp_replace(out, pattern, instead)
    return F.regexp_replace(out, r"[^a-z0-9\n]+", " ")


def canonical(text: Column) -> Column:
    """The canonical form of a text; empty for null."""
    return F.trim(F.regexp_replace(canonical_lines(text), r"[ \n]+", " "))


def catalogue(spark: SparkSession) -> DataFrame:
    """license, kind, digest, size (length of the canonical text) of the fixed catalogue."""
    known = spark.createDataFrame(KNOWN, "license string, kind string, body string")
    body = canonical(F.col("body"))
    return known.select("license", "kind", F.md5(body).alias("digest"), F.length(body).alias("size"))


def scan_licenses(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, digest (of the whole canonical text), text_license, header_licenses, n_header_lines.

    ``known`` has columns license and digest (see canonical()); by default the built-in catalogue.
    """
    docs = plain(docs, "doc_id", "text")
    possible = None
    if known is None:
        known = catalogue(docs.sparkSession)
        possible = sorted(r["size"] for r in known.select("size").distinct().collect())  # of a fixed list
    by_digest = known.where(F.col("digest") != F.md5(F.lit(""))).groupBy("digest").agg(F.min("license").alias("license"))
    lines = F.transform(F.split("by_lines", "\n"), lambda x: F.trim(x))
    lines = F.filter(lines, (lambda x: x != "") if possible is None else (lambda x: F.length(x).isin(possible)))
    units = docs.select("doc_id", canonical_lines(F.col("text")).alias("by_lines"), F.monotonically_increasing_id().alias("row"))
    whole_text = F.trim(F.regexp_replace("by_lines", r"[ \n]+", " "))
    units = stage(units.select("doc_id", F.md5(whole_text).alias("digest"), F.transform(lines, F.md5).alias("lines"), "row"), "license-units")
    whole = units.select("row", "digest").join(by_digest, "digest").select("row", F.col("license").alias("text_license"))
    hits = (
        units.select("row", F.explode("lines").alias("digest"))
        .join(by_digest, "digest")
        .groupBy("row")
        .agg(F.array_sort(F.collect_set("license")).alias("header_licenses"), F.count(F.lit(1)).alias("n_header_lines"))
    )
    return (
        units.drop("lines")
        .join(whole, "row", "left")
        .join(hits, "row", "left")
        .select(
            "doc_id",
            "digest",
            "text_license",
            F.coalesce(F.array_join("header_licenses", ","), F.lit("")).alias("header_licenses"),
            F.coalesce("n_header_lines", F.lit(0)).cast("long").alias("n_header_lines"),
        )
    )
