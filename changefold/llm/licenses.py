"""License scans by canonical digest lookup.

A text is normalised (case, punctuation, copyright lines, equivalent spellings) line by
line; the digest of the whole is joined to the digests of known licences, and each line is
looked up as a licence notice of its own. ``license_texts`` holds entire texts.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changefold.llm.common import ascii_lower, broadcast_if_small, saved

#: A copyright statement: a symbol, or the word before a symbol, a year or a name. In a line
#: of licence text, other words follow it; "(c)" alone may count a paragraph.
SIGNED = (
    r"^[^a-z0-9]*(©|&copy;|\(c\)\s*(copyright\b|[^a-z0-9]*[12][0-9]{3}\b)|\(c\).*\b(19|20)[0-9]{2}\b"
    r"|copyright\b[^a-z0-9]*(\(c\)|©|&copy;|[12][0-9]{3}\b|yyyy\b|[\[<{]))"
)
NAMED = r"^[^a-z0-9]*copyright\b[\s:,]+[^\s:,]"
NO_NAME = (
    r"^[^a-z0-9]*copyright\b[\s:,]+(also|and|are|disclaimers?|doctrines|have|holders?|if|in|including|interests?|is|laws?|license|licence|like|line|more|notices?|of|on|or|owners?|ownership|patent|permission|protection|resulting|statements?|status|that|then|those|to|treaty|under)\b"
)
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F\p{P}\p{Z}]+"
#: A line that is the title of a short licence: its name, perhaps with an article and with its id behind.
TITLE = (
    r"^(the )?(mit|mit x11|x11|expat|isc|internet systems consortium|zlib|zlib libpng|bsd zero clause|zero clause bsd|bsd 0 clause|0bsd|bsd|simplified bsd|new bsd|modified bsd|revised bsd"
    r"|(bsd )?[23] clause( bsd)?( simplified| new| revised| new or revised)?|unlicense|boost software) license( (mit|expat|isc|zlib|0bsd|bsd [23] clause|version [0-9]( [0-9])?))?$"
)
# Equivalent spellings, as whole words.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "sub license": "sublicense", "non infringement": "noninfringement",
    "merchantibility": "merchantability", "whilst": "while", "wilful": "willful", "per cent": "percent", "copyright holder": "copyright owner", "copyright holders": "copyright owners", "ver": "version", "v": "version",
}
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZERO_BSD = ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
# Licence ids with whole texts and with the notices that name them.
KNOWN = [
    ("MIT", MIT), ("MIT", "MIT License\n\n" + MIT), ("ISC", ISC), ("ISC", "ISC License\n\n" + ISC), ("0BSD", ZERO_BSD), ("0BSD", "BSD Zero Clause License\n\n" + ZERO_BSD),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC0-1.0", "Licensed under CC0 1.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."), ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."), ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("proprietary", "All rights reserved."),
]
TITLES = {"BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License"}
LEFT_OUT = re.compile(
    r"^[ \t]*(APPENDIX: How to apply|(Appendix: )?How to Apply These Terms to Your New|ADDENDUM: How to use this License|EXHIBIT A -Mozilla Public License).*",
    re.S | re.M,
)
# Addresses under which the texts of one publisher were handed out.
ADDRESS = re.compile(r"51 Franklin St(reet)?, Fifth Floor,\s+Boston,\s+MA\s+02110-1301,?\s+USA")
ADDRESSES = ["51 Franklin Street, Fifth Floor, Boston, MA 02110-1301, USA", "51 Franklin St, Fifth Floor, Boston, MA 02110-1301 USA", "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", "675 Mass Ave, Cambridge, MA 02139, USA"]


def whole_texts() -> list[tuple[str, str]]:
    """(licence id, body) of the entire texts in ``license_texts``, read on the driver, each
    also in the forms in which it is handed out: with and without its title, its numbers, what
    follows its terms, the words around a Creative Commons licence, and secure addresses."""
    found: dict[tuple[str, str], None] = {}
    for path in sorted(Path(__file__).with_name("license_texts").glob("*.txt")):
        name, body = path.stem, path.read_text(encoding="utf-8")
        forms = [body, LEFT_OUT.sub("", body), re.sub(r"END OF TERMS AND CONDITIONS\s*$", "", LEFT_OUT.sub("", body))]
        if name in TITLES:
            forms += [re.sub(r"^[0-9]\. ", "", body, flags=re.M)]
            forms += [f"All rights reserved.\n\n{x}" for x in forms]
            forms += [f"{TITLES[name]}\n\n{x}" for x in forms]
        parts = re.split(r"^={20,}$", body, flags=re.M)
        if len(parts) > 2:
            forms += [parts[2], parts[0] + parts[2], "".join(parts[:3])]
        if name == "CC0-1.0":
            forms += [body[body.index("Statement of Purpose") :], "CC0 1.0 Universal\n" + body[body.index("Statement of Purpose") :]]
        forms += [ADDRESS.sub(a, x) for a in ADDRESSES for x in forms if ADDRESS.search(x)]
        # a line of its own for each paragraph, which matters where one begins with a copyright statement
        forms += [re.sub(r"(?<=\S)[ \t]*\n[ \t]*(?=\S)", " ", x) for x in forms]
        for form in forms:
            found |= {(name, form): None, (name, form.replace("https://", "http://")): None, (name, re.sub(r"http://", "https://", form)): None}
    return list(found)


def canonical_lines(text: Column) -> Column:
    """Normalised non-empty lines: A-Z lower-cased, copyright statements dropped, runs of ASCII
    characters other than letters and digits, and of any punctuation and space, turned into one
    space, spellings made equal."""

    def normal(low: Column) -> Column:
        out = F.concat(F.lit(" "), F.regexp_replace(low, GAP, " "), F.lit(" "))
        out = F.replace(out, F.lit("  "), F.lit(" "))
        for odd, usual in SPELLINGS.items():
            out = F.replace(out, F.lit(f" {odd} "), F.lit(f" {usual} "))
        return F.when(low.rlike(SIGNED) | (low.rlike(NAMED) & ~low.rlike(NO_NAME)), F.lit("")).otherwise(F.btrim(out))

    lines = F.transform(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), ascii_lower), normal)
    return F.filter(lines, lambda x: x != "")


def joined(lines: Column) -> Column:
    """The whole of normalised lines without titles, with spellings of two words that a line end parted."""
    out = F.concat(F.lit(" "), F.array_join(F.filter(lines, lambda x: ~x.rlike(TITLE)), " "), F.lit(" "))
    for odd, usual in SPELLINGS.items():
        if " " in odd:
            out = F.replace(out, F.lit(f" {odd} "), F.lit(f" {usual} "))
    return F.btrim(out)


def known_licenses(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(license_id, canon) of known licence texts and notices, normalised like any text."""
    frame = spark.createDataFrame(known or [*KNOWN, *whole_texts()], "license_id string, body string")
    return frame.select("license_id", joined(canonical_lines(F.col("body"))).alias("canon")).distinct()


def scan_licenses(docs: DataFrame, known: DataFrame | None = None, max_known: int = 100_000) -> DataFrame:
    """One row per input row: doc_id, digest (of the normalised whole text), license_id (of
    the licence whose entire text it is, else null), notices (ids of licences that a line
    names, sorted and comma-joined), n_notices.

    Known licences are broadcast while they are no more than ``max_known``. If one text is
    known under several ids, the smallest is taken. Null and empty texts have the digest of
    an empty text and no licence; repeated rows each give a row; extra columns are left out.
    Only looked-up lines are shuffled.
    """
    known = known if known is not None else known_licenses(docs.sparkSession)
    known = known.filter("canon <> ''").groupBy("canon").agg(F.min("license_id").alias("found"))
    # a whole text is known by its digest, a line by itself
    keys = [F.struct(F.lit(True).alias("whole"), F.sha2(F.col("canon").cast("binary"), 256).alias("key")), F.struct(F.lit(False).alias("whole"), F.col("canon").alias("key"))]
    known = known.select("found", F.explode(F.array(*keys)).alias("k")).select("found", F.col("k.whole").alias("_all"), F.col("k.key").alias("_key"))
    known = broadcast_if_small(saved(known, "license-known"), 2 * max_known)
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("rid"), canonical_lines(F.col("text")).alias("lines"))
    rows = rows.withColumn("digest", F.sha2(joined(F.col("lines")).cast("binary"), 256))
    tries = rows.select(
        "doc_id", "rid", "digest",
        F.explode(F.concat(
            F.array(F.struct(F.lit(True).alias("all"), F.col("digest").alias("line"))),
            F.transform(F.array_distinct("lines"), lambda x: F.struct(F.lit(False).alias("all"), x.alias("line"))),
        )).alias("t"),
    )
    met = tries.select("doc_id", "rid", "digest", "t.all", "t.line").join(known, (F.col("line") == F.col("_key")) & (F.col("all") == F.col("_all")), "left").filter("all or found is not null")
    met = met.groupBy("doc_id", "rid", "digest").agg(
        F.count_if("all").alias("copies"), F.max(F.when(F.col("all"), F.col("found"))).alias("license_id"),
        F.sort_array(F.collect_set(F.when(~F.col("all"), F.col("found")))).alias("notices"),
    )
    met = met.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return met.select("doc_id", "digest", "license_id", F.array_join("notices", ",").alias("notices"), F.size("notices").cast("long").alias("n_notices"))
