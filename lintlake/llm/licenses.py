"""Licence scans by a positional rare-token index [native].

Base places: where the words of a known phrase stand consecutively.  Beyond them, licence templates are found by
alignment: document frequencies over the whole corpus order each template's words by rarity, and the rarest make its
positional postings; each distinct candidate text looks up all its words there, so that every template is sought with
its own rare words in every text; hits that agree on the relative position (place in the text minus place in the
template) vote for that template with their IDF; and a template counts only if its vote reaches a share of its rare
words' weight and one of its mandatory key phrases stands near the alignment.

Nulls count as empty texts (no words, no labels, score 0); null ids are kept; repeated rows and equal texts get equal
results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.llm._common import BREAKS, ascii_lower, id_and_text, park

#: Base phrases with their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Template label, mandatory key phrases (one must stand in the alignment), template text: notices of one
#: sentence first, then the paragraphs of the licences' own texts and headers.
TEMPLATES = [
    ("agpl-3.0", ["affero general public license"], "this work is licensed under the gnu affero general public license version 3"),
    ("apache-2.0", ["apache license version 2"], "licensed under the apache license version 2 0"),
    ("apache-2.0", ["except in compliance with the license"], "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("artistic-2.0", ["artistic license"], "this work is licensed under the artistic license version 2 0"),
    ("bsd", ["redistribution and use in source and binary forms"], "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsl-1.0", ["boost software license"], "distributed under the boost software license version 1 0"),
    ("cc-by-4.0", ["cc by 4 0"], "licensed under cc by 4 0"),
    ("cc-by-4.0", ["attribution 4 0"], "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc-4.0", ["cc by nc"], "licensed under cc by nc 4 0"),
    ("cc-by-nc-4.0", ["attribution noncommercial"], "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa-4.0", ["cc by sa"], "licensed under cc by sa 4 0"),
    ("cc-by-sa-4.0", ["attribution sharealike"], "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0-1.0", ["cc0 1 0", "public domain dedication"], "waived all copyright cc0 1 0 universal public domain dedication"),
    ("epl-2.0", ["eclipse public license"], "made available under the terms of the eclipse public license v 2 0"),
    ("gpl-2.0", ["general public license version 2"], "this work is licensed under the gnu general public license version 2"),
    ("gpl-3.0", ["general public license version 3"], "this work is licensed under the gnu general public license version 3"),
    ("isc", ["isc license"], "released under the isc license"),
    ("lgpl-3.0", ["lesser general public license"], "this work is licensed under the gnu lesser general public license version 3"),
    ("mit-grant", ["mit license"], "released under the mit license"),
    ("mit-grant", ["permission is hereby granted free of charge"], "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", ["mozilla public license"], "subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", ["released into the public domain"], "this is free and unencumbered software released into the public domain"),
    ("agpl-3.0", ["affero general public license as published"], "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("apache-2.0", ["licensed under the apache license version 2"], "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("bsd", ["redistributions of source code must retain the above copyright notice", "redistributions in binary form must reproduce the above copyright notice"], "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", ["neither the name of"], "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd", ["this software is provided by the copyright holders and contributors"], "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages"),
    ("bsl-1.0", ["permission is hereby granted free of charge to any person or organization"], "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software"),
    ("gpl-2.0", ["either version 2 of the license"], "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3.0", ["either version 3 of the license"], "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("isc", ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"], "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl-3.0", ["lesser general public license as published"], "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("mit-grant", ["permission is hereby granted free of charge to any person obtaining"], "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-grant", ["the software is provided as is without warranty of any kind"], "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("mpl-2.0", ["this source code form is subject to the terms of the mozilla public license"], "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"),
    ("unlicense", ["free and unencumbered software"], "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("zlib", ["provided as is without any express or implied warranty"], "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
]

#: The phrases of short words only: no substring tells them, a pattern does.
SIEVE_CC = r"(?i)cc[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+by"


def _sieve_parts() -> list[str]:
    """Words of five letters or more such that each base phrase and each key phrase has one, but those that begin with "cc by"; common words first."""
    phrases = [p.split() for p in [*PHRASES, *(k for _, keys, _ in TEMPLATES for k in keys)]]
    left, parts = [p for p in phrases if p[:2] != ["cc", "by"]], []
    while left:
        words = {w for p in left for w in p if len(w) >= 5 or max(map(len, p)) < 5}
        parts.append(max(words, key=lambda w: (sum(w in p for p in left), len(w), w)))
        left = [p for p in left if parts[-1] not in p]
    return parts


#: A text without any of these, and without SIEVE_CC, holds neither a base phrase nor a template's key phrase.
SIEVE_PARTS = _sieve_parts()


def sieved(text: Column) -> Column:
    """Whether a text may hold a phrase: plain substrings of its lower case, worked out once."""

    def some(low: Column) -> Column:
        found = low.contains("cc") & low.rlike(SIEVE_CC)
        for part in SIEVE_PARTS:
            found = low.contains(part) | found
        return found

    return F.get(F.transform(F.array(F.lower(text)), some), F.lit(0))


def words_of(text: Column) -> Column:
    """Words of a text, ASCII letters lower-cased, in order."""
    return F.filter(F.split(ascii_lower(text), f"[{BREAKS}]+"), lambda w: w != "")


def _template_words(spark) -> DataFrame:
    """word, postings: for each template word the templates and places it has.  As many rows as the fixed list has words."""
    posts: dict[str, list[tuple[int, int]]] = {}
    for t, (_, _, text) in enumerate(TEMPLATES):
        for p, w in enumerate(text.split()):
            posts.setdefault(w, []).append((t, p))
    rows = ", ".join(f"('{w}', array({', '.join(f'struct({t} as t, {p} as p)' for t, p in at)}))" for w, at in sorted(posts.items()))
    return spark.sql(f"select * from values {rows} as v(word, postings)")


def template_idf(texts: DataFrame) -> DataFrame:
    """word, postings, idf: IDF of each template word over all texts; words that no text has get the highest."""
    spark = texts.sparkSession
    vocab = _template_words(spark)
    known = F.array(*(F.lit(w) for w in sorted({w for _, _, t in TEMPLATES for w in t.split()})))
    # Per text the template words it has; map-side sums leave at most a row per word and task.  An outer explode: from a
    # plain one the optimizer infers a filter that would split every text a second time.
    seen = texts.select(F.explode_outer(F.array_intersect(known, F.split(ascii_lower("text"), f"[{BREAKS}]+"))).alias("word"))
    counts = seen.where("word is not null").groupBy("word").agg(F.count("*").alias("df"))
    n = texts.count()
    return vocab.join(F.broadcast(counts), "word", "left").select("word", "postings", F.log((F.lit(float(n)) + 1) / (F.coalesce("df", F.lit(0)) + F.lit(0.5))).alias("idf"))


def template_labels(found: DataFrame, idf: DataFrame, rarest: int = 24, share: float = 0.5, near: int = 2) -> DataFrame:
    """th, template_labels, template_score for candidate texts (th, text); found holds each text once.

    `rarest`: how many of its rarest places each template is looked up by; its further words cast no vote and aren't
    asked for.  `share`: the part of a template's weight (IDF of these) that must agree on one alignment; `near`: by how many words
    the key phrase may be off.
    """
    # One row per place of the fixed templates.
    rare = idf.select("word", "idf", F.explode("postings").alias("at")).select("word", "idf", "at.t", "at.p")
    rare = rare.withColumn("r", F.row_number().over(Window.partitionBy("t").orderBy(F.desc("idf"), "p"))).where(F.col("r") <= rarest)
    weight = rare.groupBy("t").agg(F.sum("idf").alias("full"))
    postings = rare.groupBy("word").agg(F.first("idf").alias("idf"), F.collect_list(F.struct("t", "p")).alias("postings"))
    words = found.select("th", F.posexplode(words_of(F.col("text"))).alias("i", "word"))
    hits = words.join(F.broadcast(postings), "word")
    votes = hits.select("th", "idf", "i", F.explode("postings").alias("at")).select("th", "idf", F.col("at.t").alias("t"), (F.col("i") - F.col("at.p")).alias("offset"))
    tallies = votes.groupBy("th", "t", "offset").agg(F.sum("idf").alias("vote"), F.count("*").alias("agree"))
    good = tallies.join(F.broadcast(weight), "t").withColumn("score", F.least(F.lit(1.0), F.col("vote") / F.col("full"))).where(F.col("agree") >= 3)
    # Where key phrases stand, as the alignments they are good for; joined by equality, so repeats stay linear.
    keyed = found.select("th", words_of(F.col("text")).alias("words")).select("th", F.explode(_key_places(F.col("words"))).alias("k"))
    keyed = keyed.select("th", F.col("k.t").alias("t"), F.explode(F.sequence(F.col("k.offset") - near, F.col("k.offset") + near)).alias("offset")).distinct()
    good = good.where(F.col("score") >= share).join(keyed, ["th", "t", "offset"], "left_semi")
    labels = F.array(*(F.lit(name) for name, _, _ in TEMPLATES))
    return good.groupBy("th").agg(F.array_sort(F.collect_set(F.get(labels, F.col("t")))).alias("template_labels"), F.max("score").alias("template_score"))


def _key_places(words: Column) -> Column:
    """(t, offset) for each place where a mandatory key phrase of template t stands in words."""
    keys = [(t, k.split(), _place(text.split(), k.split())) for t, (_, ks, text) in enumerate(TEMPLATES) for k in ks]
    firsts = sorted({k[0] for _, k, _ in keys})
    starts = F.filter(F.transform(words, lambda w, i: F.when(w.isin(firsts), i)), lambda i: i.isNotNull())

    def at(i: Column) -> Column:
        found = []
        for t, key, place in keys:
            test = F.get(words, i) == key[0]
            for k, w in enumerate(key[1:], 1):
                test = test & F.coalesce(F.get(words, i + k) == w, F.lit(False))
            found.append(F.when(test, F.struct(F.lit(t).alias("t"), (i - place).alias("offset"))))
        return F.filter(F.array(*found), lambda x: x.isNotNull())

    return F.flatten(F.transform(starts, at))


def _place(text: list[str], key: list[str]) -> int:
    """Where the key phrase stands in its template's text."""
    return next(i for i in range(len(text)) if text[i : i + len(key)] == key)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, template_labels, template_score, one row per row of docs."""
    rows = id_and_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("sieved", sieved(F.col("text")))
    base = rows.withColumn("words", F.when(F.col("sieved"), words_of(F.col("text")))).withColumn("n_words", F.regexp_count("text", F.lit(f"[^{BREAKS}]+")).cast("bigint"))
    spots = F.transform(F.col("words"), lambda w, i: F.struct(i.alias("i"), _label_at(F.col("words"), i, w).alias("label")))
    base = base.withColumn("spots", F.filter(spots, lambda s: s["label"].isNotNull()))
    base = base.select(
        "doc_id",
        "n_words",
        F.coalesce(F.size("spots"), F.lit(0)).cast("bigint").alias("n_base"),
        F.array_min(F.transform("spots", lambda s: s["i"])).cast("bigint").alias("first_word"),
        F.array_max(F.transform("spots", lambda s: s["i"])).cast("bigint").alias("last_word"),
        F.coalesce(F.array_sort(F.array_distinct(F.transform("spots", lambda s: s["label"]))), F.array().cast("array<string>")).alias("base_labels"),
        F.xxhash64("text", F.length("text")).alias("th"),
    )
    found = rows.where("sieved").groupBy(F.xxhash64("text", F.length("text")).alias("th")).agg(F.first("text").alias("text"))
    labels = park(template_labels(park(found, "candidates"), park(template_idf(rows), "idf")), "labels")
    return base.join(labels, "th", "left").drop("th")


def _label_at(words: Column, i: Column, word: Column) -> Column:
    label = F.lit(None).cast("string")
    for phrase, name in PHRASES.items():
        first, *rest = phrase.split()
        test = word == first
        for k, w in enumerate(rest, 1):
            test = test & F.coalesce(F.get(words, i + k) == w, F.lit(False))
        label = F.when(test, F.lit(name)).otherwise(label)
    return label


def op9_licenses(spark, sf_dir: str) -> DataFrame:
    out = license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    every = F.array_sort(F.array_distinct(F.concat("base_labels", F.coalesce("template_labels", F.array().cast("array<string>")))))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.greatest(F.lit(0.5), F.coalesce("template_score", F.lit(0.0)))).otherwise(F.coalesce("template_score", F.lit(0.0))).alias("score"),
    )
