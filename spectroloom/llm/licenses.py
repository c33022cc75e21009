"""License scans by canonical digests, with DataFrame operations only.

A text is brought to a canonical form - A-Z is lower-cased, lines that are notices of copyright go,
punctuation and white space become single spaces, equivalent spellings become one - and the SHA-256
digest of the entire form is hash-joined to the digests of known license texts and notices. Every
document is looked up as a whole and line by line.

A line is a notice only if a sign, a year, a name behind "by" or a place for one follows: items of a
list such as "(c) You must" and wrapped sentences that begin with "copyright notice" stay.
"""

from __future__ import annotations

from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spectroloom.llm.common import ascii_lower

# What a notice of copyright can hold, a line that is one, punctuation, and words and phrases taken as equal.
MARKS = ("copyright", "(c)", "©", "all rights reserved")
NOTICE = r"(?md)^[^a-z0-9\n]*(copyright[ \t\r:,]*(\(c\)|©|&copy;|[0-9<\[{]|by\b)|(\(c\)|©)[ \t\r,]*(copyright|[0-9<\[{])|all rights reserved[^a-z0-9\n]*$).*$"
PUNCTUATION = r"[\x00-\x09\x0B-\x20!-/:-@\[-`{-~“”‘’–—\x{A0}]+"
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"),
    ("cancelled", "canceled"), ("capitalisations", "capitalizations"), ("catalogue", "catalog"), ("categorise", "categorize"), ("centre", "center"), ("copyright owner", "copyright holder"),
    ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("https", "http"), ("initialise", "initialize"), ("judgement", "judgment"),
    ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"), ("maximise", "maximize"), ("merchantibility", "merchantability"), ("modelled", "modeled"), ("modelling", "modeling"), ("noncommercial", "non commercial"),
    ("noninfringement", "non infringement"), ("offence", "offense"), ("optimise", "optimize"), ("organisation", "organization"), ("organise", "organize"), ("per cent", "percent"), ("practise", "practice"), ("programme", "program"),
    ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"), ("sub license", "sublicense"), ("sub licence", "sublicense"), ("sublicence", "sublicense"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
)
#: By how much spelling changes a line's length at most, and its share of long ones: lengths tell which lines are worth a closer look.
SLACK, SHARE = 8, 20

_MIT = """MIT License

Copyright (c) <year> <holder>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """ISC License

Copyright <year> <holder>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD2 = """BSD 2-Clause License

Copyright (c) <year>, <holder>
All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

#: Known texts: license id and a whole text or a whole one-line notice.
KNOWN = (
    ("MIT", _MIT),
    ("MIT", _MIT.partition("\n\n")[2]),
    ("ISC", _ISC),
    ("ISC", _ISC.partition("\n\n")[2]),
    ("BSD-2-Clause", _BSD2),
    ("BSD-2-Clause", _BSD2.partition("\n\n")[2]),
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)
_BSD3 = _BSD2.replace("2-Clause", "3-Clause").replace("\n\nTHIS SOFTWARE", "\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE")


def license_texts() -> list[tuple[str, str]]:
    """The longer texts, one file each named by its license id, with and without what follows their terms."""
    out = [("BSD-3-Clause", _BSD3), ("BSD-3-Clause", _BSD3.partition("\n\n")[2])]
    for file in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        text = file.read_text("utf-8")
        terms, end, rest = text.partition("END OF TERMS AND CONDITIONS")
        out += [(file.stem, text)] + [(file.stem, terms + end), (file.stem, terms)] * bool(rest)
    return out


def spelled(words: Column) -> Column:
    """Words between single spaces, equivalent spellings made one."""
    # with two spaces between words each has a space of its own on either side
    out = F.concat(F.lit(" "), F.replace(words, F.lit(" "), F.lit("  ")), F.lit(" "))
    for variant, word in SPELLINGS:
        gaps = lambda t: F.lit(" " + t.replace(" ", "  ") + " ")
        out = F.replace(out, gaps(variant), gaps(word))
    # most texts have none of the variants: they are looked for once, all together
    some = F.arrays_overlap(F.split(words, " "), F.array(*[F.lit(v.split(" ")[-1] if v != "sub license" else "sub") for v, _ in SPELLINGS]))
    return F.when(some, F.trim(F.replace(out, F.lit("  "), F.lit(" ")))).otherwise(words)


def plain_words(text: Column) -> Column:
    """A text without notices of copyright, lower-cased (A-Z), its lines' words between single spaces; null: empty."""
    lower = ascii_lower(F.coalesce(text, F.lit("")))
    marked = F.contains(lower, F.lit(MARKS[0]))
    for mark in MARKS[1:]:
        marked = marked | F.contains(lower, F.lit(mark))
    kept = F.when(marked, F.regexp_replace(lower, NOTICE, "")).otherwise(lower)
    return F.regexp_replace(kept, PUNCTUATION, " ")


def joined_words(words: Column) -> Column:
    return F.trim(F.regexp_replace(words, "[ \n]+", " "))


def canonical(text: Column) -> Column:
    """The canonical form of an entire text; empty if nothing is left."""
    return spelled(joined_words(plain_words(text)))


def known_digests(spark: SparkSession, known=None) -> DataFrame:
    """(digest, license, chars) of known texts; among texts of equal form the least license id counts."""
    texts = spark.createDataFrame([(i, t) for i, t in (known or [*KNOWN, *license_texts()])], "license string, text string")
    forms = texts.select("license", canonical(F.col("text")).alias("form")).where("form <> ''")
    return forms.groupBy(F.sha2("form", 256).alias("digest"), F.length("form").alias("chars")).agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: doc_id, text_digest, text_license, n_lines, line_licenses.

    ``text_license`` is the license that the entire text is (null: none known), ``n_lines`` how
    many lines are known texts of their own and ``line_licenses`` their distinct ids, sorted. Null
    and empty texts, and texts of nothing but punctuation or notices, have the digest of the empty
    form and no license. Repeated rows are repeated, a null id is a value, other columns are ignored.
    ``known`` is (digest, license, chars: the canonical form's length); the built-in table of about a
    hundred rows is broadcast, one that is passed in only if Spark finds it small. An empty table
    gives no rows.
    """
    builtin = known is None
    known = known_digests(docs.sparkSession) if builtin else known
    table = known.groupBy("digest").agg(F.min("license").alias("license"))
    table = F.broadcast(table) if builtin else table
    words = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("hash"), plain_words(F.col(text)).alias("words"))
    lines = F.filter(F.transform(F.split("words", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    if builtin:
        # only lines of about the length of a known text are spelled and hashed
        spans: list[list[int]] = []
        for (n,) in sorted(known.select("chars").distinct().collect()):
            low, high = n - SLACK - n // SHARE, n + SLACK + n // SHARE
            if spans and low <= spans[-1][1]:
                spans[-1][1] = high
            else:
                spans.append([low, high])
        near = lambda x: reduce(lambda a, b: a | b, [F.length(x).between(*span) for span in spans], F.lit(False))
        lines = F.filter(lines, near)
    units = F.concat(
        F.array(F.struct(F.lit(True).alias("whole"), F.sha2(spelled(joined_words(F.col("words"))), 256).alias("digest"))),
        F.transform(lines, lambda x: F.struct(F.lit(False).alias("whole"), F.sha2(spelled(x), 256).alias("digest"))),
    )
    looked = words.select("doc_id", "hash", F.inline(units)).join(table, "digest", "left")
    line = ~F.col("whole") & F.col("license").isNotNull()
    per_doc = looked.groupBy("doc_id", "hash").agg(
        F.count_if("whole").alias("rows"), F.max(F.when(F.col("whole"), F.col("digest"))).alias("text_digest"), F.max(F.when(F.col("whole"), F.col("license"))).alias("text_license"),
        F.count_if(line).alias("lines"), F.sort_array(F.collect_set(F.when(line, F.col("license")))).alias("line_licenses"),
    )
    return per_doc.select("doc_id", "text_digest", "text_license", (F.col("lines") / F.col("rows")).cast("long").alias("n_lines"), "line_licenses", F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("copy")).drop("copy")
