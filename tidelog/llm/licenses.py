"""License scans by MinHash bands and exact containment, in DataFrame functions only.

Texts are read as shingles of three words.  Windows of four shingles start at every
second one, so they overlap by half.  Of each window two minima under different
masks of the shingle hashes make a band, whose key is its number and both minima.
The windows of a template start at every shingle, so a document's window meets the
one that lies alike.  The least overlap is that of a template of three shingles (the
shortest notices), which always lies inside a window: Jaccard 0.75, a band collides
with probability 0.56, one of 8 with 1 - 0.44^8 = 0.998 (a tag of two shingles: 0.9).
Of a longer template, of which a share ``containment`` must be there, some window
is whole.
Retrieved pairs are verified: the share of the template's shingles that the
document holds must reach ``containment``.

Templates are notices, tags and the passages of whole licence texts, so that a part
of a licence is found too.  They are counted and broadcast up to ``broadcast_rows``
bands of twenty bytes.

Defined results: null, empty and shorter texts give no rows; a null doc_id gives
no row; rows that share a doc_id count as one document; templates of fewer than
three words are not searched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .decontam import words

_WINDOW, _STEP, _ROWS = 4, 2, 2
_WARRANTY = ("IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
             "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
             "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, "
             "BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
             "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING "
             "IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")


def _gnu(name: str, version: str) -> str:
    return (f"This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by "
            f"the Free Software Foundation, either version {version} of the License, or (at your option) any later version.")


#: Notices, tags and passages of licence texts searched by default; fixed values.
TEMPLATES = {
    "mit": "Released under the MIT License.",
    "mit/notice": "This project is licensed under the terms of the MIT license.",
    "mit/grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
                 "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
                 "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
                 "is furnished to do so, subject to the following conditions:",
    "mit/conditions": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit/warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
                    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
                    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
                    "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0/notice": "Licensed under the Apache License 2.0",
    "apache-2.0/header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
                         "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-2.0/terms": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
                        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
                        "specific language governing permissions and limitations under the License.",
    "bsd/grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
                 "conditions are met:",
    "bsd/source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd/binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
                  "disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-3-clause/endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
                                "products derived from this software without specific prior written permission.",
    "bsd/warranty": "THIS SOFTWARE " + _WARRANTY,
    "isc/grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
                 "provided that the above copyright notice and this permission notice appear in all copies.",
    "isc/warranty": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
                    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
            "damages arising from the use of this software.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
                 "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
                 "non-commercial, and by any means.",
    "gpl-2.0/header": _gnu("GNU General Public License", "2"),
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0/header": _gnu("GNU General Public License", "3"),
    "gpl/warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty "
                    "of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "gpl/copy": "You should have received a copy of the GNU General Public License along with this program.",
    "lgpl-2.1/header": _gnu("GNU Lesser General Public License", "2.1"),
    "lgpl-3.0/header": _gnu("GNU Lesser General Public License", "3"),
    "agpl-3.0/header": _gnu("GNU Affero General Public License", "3"),
    "mpl-2.0/header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                      "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    **{f"cc-{k}-4.0": f"This work is licensed under a Creative Commons {v} 4.0 International License" for k, v in (
        ("by", "Attribution"), ("by-sa", "Attribution-ShareAlike"), ("by-nd", "Attribution-NoDerivatives"),
        ("by-nc/text", "Attribution-NonCommercial"), ("by-nc-sa", "Attribution-NonCommercial-ShareAlike"))},
    **{f"spdx/{k.lower()}": f"SPDX-License-Identifier: {k}" for k in (
        "MIT", "ISC", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-only", "GPL-3.0-or-later", "LGPL-2.1-or-later", "AGPL-3.0-only",
        "MPL-2.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0")},
}


def _masks(n: int) -> list[int]:
    """Masks whose first bits differ as much as their number allows, so that they prefer different shingles."""
    width = max(1, (n - 1).bit_length())
    return [((k << (64 - width)) | ((k + 1) * 0x9E3779B97F4A7C15 % 2 ** 64 >> width)) - 2 ** 63 for k in range(n)]


def _hashed(table: DataFrame, key: Column, text: Column) -> DataFrame:
    """(key, s): hashes of shingles of three words, in order."""
    split = table.select(key.alias("key"), F.transform(words(F.lower(text)), lambda x: F.xxhash64(x)).alias("h"))
    at = F.sequence(F.lit(0), F.size("h") - 3)
    return (split.where("key is not null and size(h) >= 3")
            .select("key", F.transform(at, lambda i: F.xxhash64(F.get("h", i), F.get("h", i + 1), F.get("h", i + 2))).alias("s")))


def _banded(shingled: DataFrame, bands: int, step: int) -> DataFrame:
    """(key, band): the bands of each window of four shingles, one at every ``step``.

    A window is a row of columns here, so minima are compiled code; a text shorter
    than a window repeats its last shingle.
    """
    masks, last = _masks(bands * _ROWS), F.size("s") - 1
    starts = F.sequence(F.lit(0), F.greatest(last - (_WINDOW - step), F.lit(0)), F.lit(step))
    rows = shingled.select("key", "s", F.explode(starts).alias("i"))
    rows = rows.select("key", *(F.get("s", F.least(F.col("i") + k, last)).alias(f"s{k}") for k in range(_WINDOW)))
    rows = rows.select("key", *(F.least(*(F.col(f"s{k}").bitwiseXOR(F.lit(m)) for k in range(_WINDOW))).alias(f"m{j}") for j, m in enumerate(masks)))
    keys = (F.xxhash64(F.lit(b), *(F.col(f"m{b * _ROWS + r}") for r in range(_ROWS))) for b in range(bands))
    return rows.select("key", F.explode(F.array(*keys)).alias("band"))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, bands: int = 8, containment: float = 0.8,
         broadcast_rows: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, n_shingles, containment, first_word) of the templates found."""
    spark = docs.sparkSession
    known = spark.range(1).select(F.inline(F.array(*(
        F.struct(F.lit(k).alias("license"), F.lit(v).alias("body")) for k, v in sorted((templates or TEMPLATES).items())))))
    ours = C.written(_hashed(known, F.col("license"), F.col("body")))
    side = C.written(_banded(ours, bands, 1).distinct().withColumnRenamed("key", "license"))
    small = side.count() <= broadcast_rows
    theirs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = _banded(_hashed(theirs, F.col("doc_id"), F.col("text")), bands, _STEP)
    hits = found.join(F.broadcast(side) if small else side, "band").select(F.col("key").alias("doc_id"), "license").distinct()
    hits = C.written(hits)
    sets = ours.select(F.col("key").alias("license"), F.array_distinct("s").alias("t"))
    texts = _hashed(theirs.join(hits.select("doc_id").distinct(), "doc_id", "left_semi"), F.col("doc_id"), F.col("text"))
    verified = (texts.withColumnRenamed("key", "doc_id").join(hits, "doc_id").join(F.broadcast(sets) if small else sets, "license")
                .withColumn("n_shingles", F.size(F.array_intersect("s", "t")).cast("long"))
                .withColumn("containment", F.col("n_shingles") / F.size("t"))
                .where(F.col("containment") >= containment)
                .withColumn("first_word", F.array_min(F.filter(F.transform("t", lambda x: F.array_position("s", x)), lambda p: p > 0)) - 1))
    return verified.groupBy("doc_id", "license").agg(
        F.max("n_shingles").alias("n_shingles"), F.max("containment").alias("containment"), F.min("first_word").alias("first_word"))
