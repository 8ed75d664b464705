"""License scans by diagonal voting. DataFrame functions only.

Every rolling pair of words of every text is joined, by hash, to the places where a template has that pair. A hit at word p of the
text and word t of the template votes for diagonal p - t. Votes are gathered by diagonal; around every diagonal, the neighbouring
ones within `slack` (the text has a few words more or less) are merged, and the span is verified: the pairs that the merged
diagonals cover must be enough of the template's. Verified neighbours make one span, whatever its length. Long notices are cut in
overlapping templates of one label. Templates are fixed, so they are broadcast; only hits and one row a text are shuffled, once.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z. Null is an empty text; empty texts and very long ones are
answered like any other, an empty table gives an empty one. Rows that repeat give repeated results; a null id is an id of its own.
Columns other than id and text are not read, and names don't clash.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The phrases that count as base places.
BASE = [("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license")]
#: Public license notices and tags.
NOTICES = [
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("apache", "licensed under the apache license version 2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program. If not, see"),
    ("gpl", "This work is licensed under the GNU General Public License version 3"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "released under the terms of the MIT license"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]
#: Words of a template at most, as its hits are the bits of a long, and of the parts that a longer notice is cut in.
LONGEST, PART = 63, 48
#: The key of each text's last word, which stands for the text.
TEXT = 0


def lowered(text: Column) -> Column:
    """Lower case; outside ASCII only the Kelvin sign would become a letter that words are compared by."""
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("é")))


def templates(phrases: list[tuple[str, str]], notices: list[tuple[str, str]]) -> list[tuple[str, bool, list[str]]]:
    """(label, whether it is a base phrase, words)."""
    out = []
    for base, rows in ((True, phrases), (False, notices)):
        for label, text in rows:
            words = re.findall(WORD, text.lower())
            assert len(words) > 1 and not (base and len(words) > LONGEST), "a template has two words or more, and a phrase at most 63"
            starts = [0] if len(words) <= LONGEST else [*range(0, len(words) - PART, PART // 2), len(words) - PART]
            out += [(label, base, words[k : k + (PART if len(starts) > 1 else LONGEST)]) for k in starts]
    return out


def template_pairs(docs: DataFrame, phrases: list[tuple[str, str]], notices: list[tuple[str, str]]) -> DataFrame:
    rows = []
    for tid, (label, base, words) in enumerate(templates(phrases, notices)):
        rows += [(tid, label, base, len(words) - 1, t, a, b) for t, (a, b) in enumerate(zip(words, words[1:], strict=False))]
    pairs = docs.sparkSession.createDataFrame(rows, "tid int, label string, base boolean, pairs int, t int, a string, b string").withColumn("h", F.xxhash64("a", "b"))
    text = docs.sparkSession.createDataFrame([(-1, None, False, 0, 0, None, None, TEXT)], pairs.schema)
    return pairs.unionByName(text)


def votes(docs: DataFrame, phrases: list[tuple[str, str]] = BASE, notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """Of docs (id, text), by id and tag (a hash of the text): for each template and diagonal the bits of the pairs that were hit, and for
    each text a row without template, of its number of words and of rows. All rows of an id and tag are in one partition."""
    rows = docs.select("id", F.xxhash64("text").alias("tag"), lowered(F.col("text")).alias("low"))
    words = F.split("low", GAP, -1)  # with an empty word where the text begins or ends with a gap
    rows = rows.select("id", "tag", F.substring("low", 1, 1).rlike(GAP).cast("int").alias("lead"), F.posexplode(F.arrays_zip(words.alias("x"), F.slice(words, F.lit(2), F.size(words)).alias("y"))).alias("p", "pair"))
    rows = rows.select("id", "tag", "lead", "p", F.col("pair.x").alias("x"), F.col("pair.y").alias("y"))
    rows = rows.withColumn("h", F.when(F.col("y").isNull(), F.lit(TEXT).cast("long")).otherwise(F.xxhash64("x", "y")))
    hits = rows.join(F.broadcast(template_pairs(docs, phrases, notices)), "h").where("(x = a and y = b) or (tid < 0 and y is null)")
    n_words = F.col("p") + 1 - F.col("lead") - (F.col("x") == "").cast("int")
    hits = hits.select("id", "tag", "tid", "label", "base", "pairs", F.when(F.col("tid") < 0, n_words).otherwise(F.col("p") - F.col("lead") - F.col("t")).alias("diagonal"), F.expr("shiftleft(1L, t)").alias("bit"))
    # rows that are alike, however many, are one a task before anything moves; then what is left comes together by id and tag
    return hits.groupBy("id", "tag", "tid", "label", "base", "pairs", "diagonal").agg(F.bit_or("bit").alias("bits"), F.count("*").alias("n")).repartition("id", "tag")


def verified(found: DataFrame, coverage: float, slack: int) -> DataFrame:
    """What stands of votes: texts as they are, and the spans of templates: id, tag, label, base, start, stop, covered, n_words, copies."""
    by = Window.partitionBy("id", "tag", "tid").orderBy("diagonal")
    near = by.rangeBetween(-slack, slack)
    lowest, highest = F.log2(F.expr("cast(bits & -bits as double)")).cast("int"), F.floor(F.log2(F.col("bits").cast("double"))).cast("int")
    rows = found.withColumn("merged", F.when(F.col("base") | (F.col("tid") < 0), F.col("bits")).otherwise(F.bit_or("bits").over(near)))
    rows = rows.withColumn("start", F.min(F.col("diagonal") + lowest).over(near)).withColumn("stop", F.max(F.col("diagonal") + highest + 2).over(near))
    rows = rows.withColumn("covered", F.when(F.col("tid") >= 0, F.bit_count("merged") / F.col("pairs")))
    rows = rows.where(F.when(F.col("tid") < 0, F.lit(True)).when(F.col("base"), F.col("covered") == 1).otherwise(F.col("covered") >= coverage))
    rows = rows.withColumn("jump", (F.col("base") | (F.col("diagonal") - F.lag("diagonal", 1, -(2**30)).over(by) > slack)).cast("int"))
    rows = rows.withColumn("island", F.sum("jump").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    text, base = F.col("tid") < 0, F.col("base")
    return rows.groupBy("id", "tag", "tid", "label", "base", "island").agg(
        F.when(F.first(base), F.min("diagonal")).otherwise(F.min("start")).alias("start"),
        F.when(F.first(base), F.min("diagonal") + F.max("pairs") + 1).otherwise(F.max("stop")).alias("stop"),
        F.max("covered").alias("covered"), F.max(F.when(text, F.col("diagonal"))).alias("n_words"), F.max(F.when(text, F.col("n"))).alias("copies"),
    )


def scan(docs: DataFrame, phrases: list[tuple[str, str]] = BASE, notices: list[tuple[str, str]] = NOTICES, coverage: float = 0.6, slack: int = 3) -> DataFrame:
    """Spans of templates in docs (id, text): id, tag, label, base, start, stop, covered; rows that repeat are told once."""
    return verified(votes(docs, phrases, notices), coverage, slack).where("tid >= 0").select("id", "tag", "label", "base", "start", "stop", "covered")


def license_report(docs: DataFrame, phrases: list[tuple[str, str]] = BASE, notices: list[tuple[str, str]] = NOTICES, coverage: float = 0.6, slack: int = 3) -> DataFrame:
    """One row for each of docs (id, text): words, base places and labels, all labels, the best covered share and the spans as JSON."""
    base, span = F.when(F.col("base"), F.col("start")), F.struct("start", "stop", "label")
    out = verified(votes(docs, phrases, notices), coverage, slack).groupBy("id", "tag").agg(
        F.max("n_words").cast("long").alias("n_words"), F.count(base).alias("n_base"), F.min(base).cast("long").alias("first_word"), F.max(base).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.coalesce(F.max("covered"), F.lit(0.0)).alias("score"),
        F.to_json(F.array_sort(F.collect_set(F.when(F.col("tid") >= 0, span)))).alias("spans"), F.max("copies").alias("copies"),
    )
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select("id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
