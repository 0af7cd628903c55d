"""License scan: base phrases, and a positional index of the rarest words of licence notices.

Notices are templates with key phrases. The document frequencies of their words are counted over all
documents; each template is indexed by its words of highest IDF, with their places. Files are looked up by their
licence words of highest IDF: a template can only agree where a file has one of the few words that make up more
than half of its weight, so all other files are done with. The places of indexed words in a file, less their
places in the template, agree where the notice stands: weights (IDF) of the words that agree, allowing for a few
words put in or left out, are summed for each file, template and place, and where enough of a template's
weight agrees its key phrases are verified.

Everything is DataFrame expressions. Most files have none of the words and cost one split; only the words of
the others are opened into rows, and only those of the index. Nothing but these rows and one short row a
file is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of words, and what lies between them; the commonest ranges come first.
WORD = r"[a-z\x{80}-\x{10FFFF}A-Z0-9]"
SEPARATORS = r"[^a-z\x{80}-\x{10FFFF}A-Z0-9]+"
#: Phrase and label of the base rules.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Label, notice, key phrases.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction", ("permission is hereby granted free of charge", "deal in the software without restriction")),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("permission is hereby granted free of charge", "the rights to use copy modify merge publish distribute sublicense and or sell copies")),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", ("apache license", "unless required by applicable law or agreed to in writing")),
    ("gpl-2.0", "gnu general public license version 2", ("general public license", "version 2")),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ("gnu general public license as published by the free software foundation", "version 2")),
    ("gpl-3.0", "gnu general public license version 3", ("general public license", "version 3")),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu general public license as published by the free software foundation", "version 3")),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", ("distributed in the hope that it will be useful", "gnu general public license")),
    ("lgpl", "gnu lesser general public license", ("lesser general public license",)),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license as published by",)),
    ("agpl", "gnu affero general public license", ("affero general public license",)),
    ("cc-by-nc", "this work is licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "this work is licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-nc", "creative commons attribution noncommercial license", ("attribution noncommercial",)),
    ("cc-by-sa", "creative commons attribution sharealike license", ("attribution sharealike",)),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work creative commons cc0 1 0 universal", ("waived all copyright and related or neighboring rights",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("bsd-2-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ("redistributions of source code must retain the above copyright notice", "redistributions in binary form must reproduce the above copyright notice")),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("may be used to endorse or promote products derived from this software", "without specific prior written permission")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "with or without fee")),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0", ("mozilla public license", "if a copy of the mpl was not distributed with this file")),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0", ("eclipse public license",)),
    ("bsl-1.0", "distributed under the boost software license version 1 0 see accompanying file license 1 0 txt or copy at https www boost org license 1 0 txt", ("boost software license",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", ("in no event will the authors be held liable", "to alter it and redistribute it freely")),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("proprietary", "copyright all rights reserved unauthorized copying of this file is strictly prohibited", ("all rights reserved", "unauthorized copying")),
)
#: Words that are too common to index whatever the corpus.
COMMON = frozenset("a and any are at by can do for form free in into is it not of on or other provided subject terms that the this to under use with without you work".split())
#: Indexed words of a template; places that count as one; least share of its weight that must agree.
RAREST, NEARBY, AGREES = 8, 8, 0.5


def lowered(text: Column) -> Column:
    """A-Z in lower case. lower() makes one other character an ASCII letter, the Kelvin sign, which is set apart."""
    return F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u00e9")))


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{WORD}+")).cast("long")


def phrase(words: str) -> str:
    """Pattern of a phrase that stands as whole words, in any ASCII case."""
    return f"(?i)(?<!{WORD}){SEPARATORS.join(words.split())}(?!{WORD})"


def based(rows: DataFrame) -> DataFrame:
    """rows (id, text, mark) with n_words, n_base, first_word, last_word, base_labels (array)."""
    rows = rows.withColumn("n_words", count_words(F.col("text")))
    low = lowered(F.col("text"))
    places = []
    for words, label in BASE:
        some = F.lit(True)
        for w in words.split():
            some = some & F.contains(low, F.lit(w))
        rest = F.when(some, F.split("text", phrase(words), -1))
        places.append(F.when(F.size(rest) > 1, F.struct(F.lit(label).alias("label"), (F.size(rest) - 1).cast("long").alias("n"), count_words(F.element_at(rest, 1)).alias("first"), (F.col("n_words") - count_words(F.element_at(rest, -1)) - len(words.split())).alias("last"))))
    rows = rows.withColumn("found", F.array_compact(F.array(*places)))
    return rows.select("id", "mark", "n_words", F.aggregate("found", F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("n_base"), F.array_min(F.col("found.first")).alias("first_word"), F.array_max(F.col("found.last")).alias("last_word"), F.col("found.label").alias("base_labels"))


def noticed(rows: DataFrame) -> DataFrame:
    """id, mark, labels (array), score of the rows in which templates are found."""
    vocabulary = sorted({w for _, text, _ in TEMPLATES for w in text.split()} - COMMON)
    known = F.array(*map(F.lit, vocabulary))
    words = F.split(lowered(F.col("text")), SEPARATORS)
    seen = rows.select(F.explode(F.array_intersect(words, known)).alias("word")).groupBy("word").count()
    counts = {r["word"]: r["count"] for r in seen.collect()}  # at most one row a word of the templates
    n = rows.count()
    idf = {w: math.log((1 + n) / (1 + counts.get(w, 0))) + 1e-6 for w in vocabulary}
    postings, total = [], []
    for t, (_, text, _) in enumerate(TEMPLATES):
        rare = set(sorted({w for w in text.split() if w in idf}, key=lambda w: (-idf[w], w))[:RAREST])
        own = [(w, t, place, idf[w]) for place, w in enumerate(text.split()) if w in rare]
        postings += own
        total.append(sum(p[3] for p in own))
    index = rows.sparkSession.createDataFrame(postings, "word string, template int, place int, weight double")
    spaced = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    keys = sum((_all([F.contains(F.col("spaced"), F.lit(f" {k} ")) for k in ks]).cast("long") * (1 << t) for t, (_, _, ks) in enumerate(TEMPLATES)), F.lit(0).cast("long"))
    asked = sorted({w for t in range(len(TEMPLATES)) for w in needed([p for p in postings if p[1] == t])})
    some = rows.select("id", "mark", words.alias("words")).where(F.arrays_overlap("words", F.array(*map(F.lit, asked)))).withColumn("words", F.array_remove("words", ""))
    some = some.withColumn("spaced", spaced).select("id", "mark", "words", keys.alias("keys"))
    opened = some.select("id", "mark", "keys", F.posexplode("words").alias("at", "word")).where(F.col("word").isin(sorted({p[0] for p in postings})))
    shift = F.col("at") - F.col("place") + 1024
    near = F.array(F.floor(shift / NEARBY) * 2, F.floor((shift + NEARBY // 2) / NEARBY) * 2 + 1)
    votes = opened.join(F.broadcast(index), "word").select("id", "mark", "keys", "template", "place", "weight", F.explode(near).alias("near"))  # a bounded index
    # one vote a place of the template, however often its word stands nearby
    votes = votes.groupBy("id", "mark", "keys", "template", "near", "place").agg(F.max("weight").alias("weight")).groupBy("id", "mark", "keys", "template", "near").agg(F.sum("weight").alias("agreed"))
    share = F.least(F.lit(1.0), F.col("agreed") / F.element_at(F.array(*map(F.lit, total)), F.col("template") + 1))
    label = F.element_at(F.array(*[F.lit(t[0]) for t in TEMPLATES]), F.col("template") + 1)
    fine = votes.select("id", "mark", "keys", "template", share.alias("score"), label.alias("label")).where((F.col("score") >= AGREES) & (F.expr("shiftright(keys, template) & 1") == 1))
    return fine.groupBy("id", "mark").agg(F.collect_set("label").alias("labels"), F.round(F.max("score"), 9).alias("score"))


def needed(postings: list[tuple[str, int, int, float]]) -> list[str]:
    """The fewest words of highest IDF without which less than ``AGREES`` of a template's weight is left."""
    weights: dict[str, float] = {}
    for word, _, _, weight in postings:
        weights[word] = weights.get(word, 0) + weight
    idf = {word: weight for word, _, _, weight in postings}
    left, out = sum(weights.values()), []
    enough = AGREES * left * (1 - 1e-9)
    for word in sorted(weights, key=lambda w: (-idf[w], w)):
        if left < enough:
            break
        left -= weights[word]
        out.append(word)
    return out


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row of docs.

    Words are as in ``WORD``, A-Z lower-cased. n_base counts all places where the words of a base phrase stand
    consecutively; first_word and last_word are where the first and the last of these start, from 0, null
    without any. base_labels and labels (those of the base rules and of the templates) are distinct, sorted
    and joined by commas, empty if there are none. score is the largest share of a found template's weight
    that agrees, 0 without one. Null texts are empty. Rows that repeat an id are scanned one by one.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("mark"))
    found = noticed(rows).select(F.col("id").alias("found_id"), F.col("mark").alias("found_mark"), "labels", "score")
    base = based(rows)
    both = base.join(found, F.col("id").eqNullSafe(F.col("found_id")) & (F.col("mark") == F.col("found_mark")), "left")
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    none = F.array().cast("array<string>")
    return both.select("id", "n_words", "n_base", "first_word", "last_word", joined(F.col("base_labels")).alias("base_labels"), joined(F.concat("base_labels", F.coalesce("labels", none))).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))


def oracle() -> str:
    """DuckDB SQL for the columns of ``scan`` over documents (of distinct ids)."""
    rows = ", ".join(f"({t}, '{label}', '{w}', {place})" for t, (label, text, _) in enumerate(TEMPLATES) for place, w in enumerate(text.split()) if w not in COMMON)
    keys = " OR ".join(f"(template = {t} AND " + " AND ".join(f"contains(line, ' {k} ')" for k in ks) + ")" for t, (_, _, ks) in enumerate(TEMPLATES))
    nexts = ["word", "lead(word) OVER q", "lead(word, 2) OVER q"]
    base = " UNION ALL ".join(f"SELECT doc_id, i, '{label}' AS label FROM b WHERE " + " AND ".join(f"w{n} = '{w}'" for n, w in enumerate(words.split())) for words, label in BASE)
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(replace(coalesce(text, ''), chr(8490), 'é')), '[a-z\x{{80}}-\x{{10FFFF}}0-9]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM d),
b AS (SELECT doc_id, i, {", ".join(f"{x} AS w{n}" for n, x in enumerate(nexts))} FROM p WINDOW q AS (PARTITION BY doc_id ORDER BY i)),
h AS ({base}),
bs AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels FROM h GROUP BY doc_id),
t(template, label, word, place) AS (VALUES {rows}),
df AS (SELECT word, count(DISTINCT doc_id) AS n FROM p WHERE word IN (SELECT word FROM t) GROUP BY word),
idf AS (SELECT word, ln((1 + (SELECT count(*) FROM documents)) / (1 + coalesce(n, 0))::DOUBLE) + 1e-6 AS weight FROM (SELECT DISTINCT word FROM t) LEFT JOIN df USING (word)),
rare AS (SELECT template, word, weight FROM (SELECT *, row_number() OVER (PARTITION BY template ORDER BY weight DESC, word) AS r FROM (SELECT DISTINCT template, word FROM t) JOIN idf USING (word)) WHERE r <= {RAREST}),
post AS (SELECT template, label, word, place, weight FROM t JOIN rare USING (template, word)),
total AS (SELECT template, sum(weight) AS total FROM post GROUP BY template),
v AS (SELECT doc_id, template, label, place, weight, unnest([(i - place + 1024) // {NEARBY} * 2, (i - place + 1024 + {NEARBY // 2}) // {NEARBY} * 2 + 1]) AS near FROM p JOIN post USING (word)),
a AS (SELECT doc_id, template, label, near, sum(weight) AS agreed FROM (SELECT DISTINCT * FROM v) GROUP BY ALL),
m AS (SELECT a.doc_id, label, template, least(1.0, agreed / total) AS score FROM a JOIN total USING (template) WHERE agreed / total >= {AGREES}),
s AS (SELECT doc_id, ' ' || array_to_string(w, ' ') || ' ' AS line FROM d WHERE doc_id IN (SELECT doc_id FROM m)),
f AS (SELECT doc_id, list(DISTINCT label) AS labels, round(max(score), 9) AS score FROM m JOIN s USING (doc_id) WHERE {keys} GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(bs.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(bs.labels, f.labels))), ','), '') AS labels, coalesce(f.score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN bs USING (doc_id) LEFT JOIN f USING (doc_id)
"""
