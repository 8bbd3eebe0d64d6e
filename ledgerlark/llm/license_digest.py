"""Licence scan by canonical digest.

A text is brought to a canonical form: apostrophes, ligatures and case folded,
copyright lines dropped, equivalent spellings unified, every run of signs that are
neither letters nor digits one blank.  Its SHA-256 digest is joined with the digests of
known licence texts brought to the same form, so whole texts match whole texts whatever
their case, punctuation, wrapping or copyright holder.  A copyright line goes as one line:
where it is itself wrapped, its first line alone goes.

Known are the digests of full licence texts (``license_table``) and short notices that
stand for a licence; a table ``(licence, text)`` can replace both.  ``unit="text"`` matches the whole
text; ``unit="line"`` matches every line of it, each as a whole.

Edge cases: null and empty texts, and texts with no letter or digit left, match
nothing; texts of any length are digested whole; rows are returned as often as they
occur; two known texts with one canonical form give the licence that sorts first; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_table import DIGESTS

# Spellings that licence matching treats as the same word.
EQUIVALENT = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "licencing": "licensing",
    "sublicence": "sublicense", "favour": "favor", "honour": "honor", "organisation": "organization",
    "organisations": "organizations", "centre": "center", "acknowledgement": "acknowledgment",
    "acknowledgements": "acknowledgments", "fulfil": "fulfill", "fulfilment": "fulfillment",
    "judgement": "judgment", "labour": "labor", "programme": "program", "recognise": "recognize",
    "utilisation": "utilization", "whilst": "while", "wilful": "willful", "noncommercial": "non commercial",
    "merchantibility": "merchantability", "initialise": "initialize", "analyse": "analyze",
    "authorised": "authorized", "behaviour": "behavior", "cancelled": "canceled", "catalogue": "catalog",
    "v1": "version 1", "v2": "version 2", "v3": "version 3", "https": "http",
}

# Notices that stand for a licence.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
]

# Short licence texts; digests of these and of longer ones are in ``license_table``.
TEXTS = [
    (
        "MIT",
        """MIT License

Copyright (c) <year> <holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "ISC",
        """ISC License

Copyright (c) <year> <holders>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
]

KNOWN = NOTICES + TEXTS


def _then(value: Column, step) -> Column:
    """``step(value)`` with the value worked out once, however often the step names it."""
    return F.element_at(F.transform(F.array(value), step), 1)


# A line that states a copyright.  After the word or sign comes a year or
# its placeholder, an angle bracket or "by"; or the word has a sign beside it; or it is written
# "Copyright" and no running text follows.  "copyright notice", "COPYRIGHT HOLDERS BE LIABLE"
# and "(c) You must" are running text, wherever a line breaks.
_GAP, _BLANK = r"[^\p{L}\p{N}\n<]*", r"[ \t:,]*"
_RUNNING = (
    r"(?!(?i:notices?|holders?|owners?|licen[cs]es?|laws?|acts?|treaty|treaties|rights?|interests?|status|statements?"
    r"|office|protection|information|and|or|nor|in|on|of|to|for|with|is|are|as|may|shall|must|this|that|if|you|your|also|means)\b)"
)
_COPYRIGHT_LINE = (
    rf"(?mu)^[^\p{{L}}\p{{N}}\n]*(?:"
    rf"(?:(?i:copyright|\(c\)|©){_GAP})+(?i:\d{{4}}\b|<|by\b|yyyy\b)"
    rf"|(?i:copyright){_BLANK}(?i:\(c\)|©){_BLANK}{_RUNNING}\p{{L}}"
    rf"|(?:(?i:\(c\)){_BLANK})?(?:Copyright|©){_BLANK}{_RUNNING}\p{{L}}"
    r")[^\n]*$"
)


def _without_copyright(text: Column) -> Column:
    return F.when(text.rlike(r"(?i)copyright|\(c\)|©"), F.regexp_replace(text, _COPYRIGHT_LINE, "\n")).otherwise(text)


def _plain_signs(text: Column) -> Column:
    out = F.regexp_replace(text, r"[’']s\b", "s")
    for odd, plain in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        out = F.replace(out, F.lit(odd), F.lit(plain))
    return F.when(text.rlike("[’'ﬀ-ﬄ]"), out).otherwise(text)


def _unified(words: Column) -> Column:
    same = F.create_map(*(F.lit(x) for pair in EQUIVALENT.items() for x in pair))
    out = F.array_join(F.transform(F.split(words, " "), lambda w: F.coalesce(same[w], w)), " ")
    return F.when(words.rlike(f"(?:^| )(?:{'|'.join(EQUIVALENT)})(?: |$)"), out).otherwise(words)


def canonical(text: Column) -> Column:
    """The canonical form of a text; empty if nothing is left."""
    folded = _then(F.lower(_then(text, _without_copyright)), _plain_signs)
    return _then(F.trim(F.regexp_replace(folded, r"(?U)[^\p{L}\p{N}]+", " ")), _unified)


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form; null if nothing is left."""
    return _then(canonical(text), lambda form: F.when(form != "", F.sha2(form, 256)))


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """``(digest, licence)`` of known texts, one row per canonical form.

    Without ``known``: of ``KNOWN`` and of the digest table.
    """
    texts = spark.createDataFrame(KNOWN if known is None else known, "licence string, text string")
    rows = texts.select(digest(F.col("text")).alias("digest"), "licence").where("digest is not null")
    if known is None:
        rows = rows.unionByName(spark.createDataFrame([(d, name) for name, ds in DIGESTS.items() for d in ds], "digest string, licence string"))
    return rows.groupBy("digest").agg(F.min("licence").alias("licence"))


def scan(
    docs: DataFrame, known: DataFrame | None = None, unit: str = "text", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id_col, digest, licence)`` per row, or with ``place`` per matching line.

    ``unit="text"``: every row, ``licence`` null where the text is no known one.
    ``unit="line"``: one row ``(id_col, place, digest, licence)`` per known line,
    ``place`` counted from 0.
    """
    known = known_digests(docs.sparkSession) if known is None else known
    if unit == "text":
        rows = docs.select(F.col(id_col), digest(F.col(text_col)).alias("digest"))
        return rows.join(known, "digest", "left").select(id_col, "digest", "licence")
    if unit != "line":
        raise ValueError("unit must be 'text' or 'line'")
    lines = docs.select(F.col(id_col), F.posexplode(F.split(text_col, "\n")).alias("place", "line"))
    return lines.select(id_col, "place", digest(F.col("line")).alias("digest")).join(known, "digest").select(id_col, "place", "digest", "licence")
