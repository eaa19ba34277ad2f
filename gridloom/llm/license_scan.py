"""Licence scan with a positional index of rare words; DataFrame operations only.

A template is a licence's name or its whole text, and key phrases that must stand in the file as well. Templates are cut into
parts of some words. The index has a part's two words of highest IDF over all documents, with their places in it. In a file
the places of the rarest words are looked up in the index; each posting says where its part would begin, the second word must
stand at its place relative to the first, and then all words of the part are compared. A template fits if enough of its parts
are found and every key phrase is.
"""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, replaced


class Template(NamedTuple):
    """label, words to find, key phrases that must stand anywhere in the file, and the share of the parts that must be found."""

    label: str
    text: str
    keys: tuple[str, ...] = ()
    share: float = 1.0


#: Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Names of licences.
NAMES = [
    Template("gpl-2.0", "gnu general public license version 2"),
    Template("gpl-3.0", "gnu general public license version 3"),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("apache-2.0", "apache license version 2 0"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-nd", "cc by nd"),
    Template("mpl", "mozilla public license"),
    Template("bsd", "bsd license"),
    Template("bsd", "redistribution and use in source and binary forms", ("this list of conditions",)),
    Template("mit", "permission is hereby granted free of charge", ("the software is provided as is",)),
]
#: Whole texts of licences and notices without what their users fill in.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE
LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE."""
BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND
CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF
USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
DAMAGE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be
misrepresented; you must not claim that you wrote the original software."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either
express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR
A PARTICULAR PURPOSE."""
TEXTS = [
    Template("mit", MIT, ("without restriction including without limitation",), 0.6),
    Template("isc", ISC, ("with or without fee is hereby granted",), 0.6),
    Template("bsd-2-clause", BSD_2, ("redistributions in binary form must reproduce",), 0.6),
    Template("bsd-3-clause", BSD_2, ("redistributions in binary form must reproduce", "may be used to endorse or promote products"), 0.6),
    Template("zlib", ZLIB, ("you must not claim that you wrote the original software",), 0.6),
    Template("apache-2.0", APACHE_NOTICE, ("you may not use this file except in compliance",), 0.6),
    Template("gpl-3.0", GPL_NOTICE, ("either version 3 of the license",), 0.6),
]
TEMPLATES = NAMES + TEXTS

#: Words of a part; a template's last part takes up to half as many more. Words of all templates at most, as they are one literal.
PART, MOST_WORDS = 16, 100_000
#: Fixed value: what stands between words.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORDS = {c: " " for c in [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]} | {c: c + 32 for c in range(0x41, 0x5B)}


def words_in(text: str) -> list[str]:
    """The words of a template or phrase."""
    return [w for w in text.translate(WORDS).split(" ") if w]


def loaded(table: DataFrame) -> list[Template]:
    """Templates from a table: label, text, keys array, share (null: 1). A table of many more words than licences have raises."""
    rows = table.select("label", "text", "keys", F.coalesce("share", F.lit(1.0)).alias("share")).where("label is not null and text is not null")
    if (rows.agg(F.sum(F.length("text"))).first()[0] or 0) > 10 * MOST_WORDS:
        raise ValueError(f"templates may have {MOST_WORDS} words")
    return [Template(r.label, r.text, tuple(r["keys"] or ()), r.share) for r in rows.orderBy("label", "text").collect()]


def parts_of(words: list[str]) -> list[list[str]]:
    cuts = [*range(0, max(1, len(words) - PART // 2), PART), len(words)]
    return [words[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def all_templates(templates: list[Template] | None = None) -> list[tuple[str, list[list[str]], list[list[str]], int, bool]]:
    """(label, parts' words, key phrases' words, parts that must be found, whether of the base)."""
    out = [(label, [p.split()], [], 1, True) for p, label in BASE.items()]
    for label, text, keys, share in TEMPLATES if templates is None else templates:
        if parts := [p for p in parts_of(words_in(text)) if p]:
            out.append((label, parts, [words_in(k) for k in keys], max(1, -(-int(share * 1000) * len(parts) // 1000)), False))
    return out


def lowered(text: Column) -> Column:
    """A-Z lower-cased; texts of ASCII alone take the faster way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(lower_ascii(text))


def word_array(text: Column) -> Column:
    """The words of a text; null has none."""
    whole = F.split(lowered(F.coalesce(text, F.lit(""))), BREAK)

    def trimmed(w: Column) -> Column:
        before = (F.element_at(w, 1) == "").cast("int")
        after = ((F.size(w) > 1) & (F.element_at(w, -1) == "")).cast("int")
        return F.slice(w, before + 1, F.size(w) - before - after)

    return F.transform(F.array(whole), trimmed)[0]


def document_frequencies(words: DataFrame, column: str, vocabulary: list[str]) -> dict[str, int]:
    """Over all rows, how many hold each word of the vocabulary; a row a word comes to the driver."""
    held = words.select(F.explode(F.array_intersect(column, F.array(*map(F.lit, vocabulary)))).alias("w"))
    return {r.w: r.n for r in held.groupBy("w").agg(F.count("*").alias("n")).collect()}


def anchors(words: list[str], frequency: dict[str, int]) -> tuple[int, int]:
    """The places of a part's two words of highest IDF, the first of equal ones; a part of one word has it twice."""
    by = sorted(range(len(words)), key=lambda i: (frequency.get(words[i], 0), i))
    return by[0], by[1 if len(by) > 1 else 0]


def literal(rows: list[dict], kind: str) -> Column:
    """Rows as one constant array of structs."""
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{kind}>>")


def scan_licenses(docs: DataFrame, text: str = "text", templates: list[Template] | None = None) -> DataFrame:
    """docs with n_words, n_base (long), first_word, last_word (long, null without a base place), base_labels, labels (strings,
    distinct labels sorted and joined by commas, empty without any) and score (0 to 1).

    Words are runs of ASCII letters, digits and non-ASCII characters with A-Z lower-cased; n_base counts all places at which
    the words of a base phrase stand consecutively. A template adds its label where enough of its parts stand in the text,
    each with its words consecutively, and each of its key phrases does; templates come from TEMPLATES, a list, or a table
    through loaded(). The score is L / (L + 1) for the template of most found words L, 0 without one. Null and empty texts
    have no words; texts of any length are scanned whole. Repeated rows are scanned alike; an empty table gives an empty one;
    other columns stay, those of the seven names are replaced. Two scans of the texts, no shuffle of them.
    """
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    known = all_templates(templates)
    parts = [(t, p) for t, (_, found, *_) in enumerate(known) for p in found]
    vocabulary = sorted({w for _, p in parts for w in p})
    df = replaced(docs, [*names, "_words", "_at", "_hits", "_line", "_fits"])
    kept = [F.col(f"`{c}`") for c in df.columns]
    df = df.withColumn("_words", word_array(F.col(f"`{text}`")))
    frequency = document_frequencies(df, "_words", vocabulary)
    index = []
    for k, (t, p) in enumerate(parts):
        a, b = anchors(p, frequency)
        index.append({"k": k, "t": t, "w": p[a], "a": a, "w2": p[b], "b": b, "words": p})
    rare = sorted({e["w"] for e in index})
    postings = literal(index, "k:int,t:int,w:string,a:int,w2:string,b:int,words:array<string>")

    places = F.filter(F.transform("_words", lambda w, i: F.when(w.isin(*rare), F.struct(w.alias("w"), i.alias("i")))), lambda x: x.isNotNull())
    df = df.withColumn("_at", F.when(F.arrays_overlap("_words", F.array(*map(F.lit, rare))), places))

    def found_at(x: Column) -> Column:
        """The parts that begin so that the word x stands at its place in them."""
        fits = lambda e: (e["w"] == x["w"]) & (x["i"] >= e["a"]) & F.coalesce(F.get("_words", x["i"] - e["a"] + e["b"]) == e["w2"], F.lit(False))
        whole = lambda e: F.slice("_words", x["i"] - e["a"] + 1, F.size(e["words"])) == e["words"]
        some = F.filter(F.filter(postings, fits), whole)
        return F.transform(some, lambda e: F.struct(e["k"].alias("k"), e["t"].alias("t"), F.size(e["words"]).alias("n"), (x["i"] - e["a"]).alias("s")))

    df = df.withColumn("_hits", F.flatten(F.transform("_at", found_at)))
    df = df.withColumn("_line", F.when(F.size("_hits") > 0, F.concat(F.lit(" "), F.array_join("_words", " "), F.lit(" "))))
    rules = literal([{"t": t, "label": label, "keys": [f" {' '.join(k)} " for k in keys], "least": least} for t, (label, _, keys, least, _) in enumerate(known)], "t:int,label:string,keys:array<string>,least:int")
    own = lambda r: F.array_distinct(F.transform(F.filter("_hits", lambda h: h["t"] == r["t"]), lambda h: F.struct(h["k"], h["n"])))
    counted = F.transform(rules, lambda r: F.struct(r["t"].alias("t"), r["label"].alias("label"), r["keys"].alias("keys"), r["least"].alias("least"), own(r).alias("found")))
    fits = F.filter(counted, lambda r: (F.size(r["found"]) >= r["least"]) & F.forall(r["keys"], lambda k: F.col("_line").contains(k)))
    df = df.withColumn("_fits", F.when(F.size("_hits") > 0, F.transform(fits, lambda r: F.struct(r["t"].alias("t"), r["label"].alias("label"), F.aggregate(r["found"], F.lit(0), lambda n, f: n + f["n"]).alias("n")))))
    base = F.transform(F.filter("_hits", lambda h: h["t"] < len(BASE)), lambda h: h["s"])
    joined = lambda rows: F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform(rows, lambda r: r["label"]))), ","), F.lit(""))
    most = F.array_max(F.transform("_fits", lambda r: r["n"]))
    return df.select(
        *kept,
        F.size("_words").cast("long").alias("n_words"),
        F.coalesce(F.size(base), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(base).cast("long").alias("first_word"),
        F.array_max(base).cast("long").alias("last_word"),
        joined(F.filter("_fits", lambda r: r["t"] < len(BASE))).alias("base_labels"),
        joined(F.col("_fits")).alias("labels"),
        F.coalesce(most / (most + 1), F.lit(0.0)).alias("score"),
    )
