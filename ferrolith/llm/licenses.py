"""License scans by a positional index of rare template words (DataFrame operations only).

Each template is indexed under its words of highest inverse document frequency, with their positions. A file looks up every
index word that it holds; each occurrence votes for the place where a template would begin. A place with votes from
enough different words is a candidate, which holds if the template's mandatory phrase stands where it should.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrolith.llm.url_filter import LOWER, UPPER

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: (label, words that stand consecutively)
PHRASES = (("mit", ("mit", "license")), ("apache", ("apache", "license")), ("gpl", ("general", "public", "license")))


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    mandatory: str

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def mandatory_at(self) -> int:
        words, phrase = self.words, self.mandatory.split()
        return next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)


#: Short references, and the notices that files carry, sentence by sentence: an edit in one
#: sentence then leaves the others where they are.
TEMPLATES = (
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    Template("mit", "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "use copy modify merge publish distribute sublicense"),
    Template("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "shall be included in all copies or substantial portions"),
    Template("apache", "licensed under the apache license version 2 0", "apache license"),
    Template("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "except in compliance with the license"),
    Template("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind", "required by applicable law or agreed to in writing"),
    Template("gpl", "this work is licensed under the gnu general public license version 3", "general public license"),
    Template("gpl", "released under the gnu gpl version 3", "gnu gpl"),
    Template("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    Template("lgpl", "licensed under the gnu lesser general public license version 3", "lesser general public license"),
    Template("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    Template("agpl", "licensed under the gnu affero general public license version 3", "affero general public license"),
    Template("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    Template("cc0", "dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law", "public domain by waiving all"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions of source code must retain"),
    Template("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation", "redistributions in binary form must reproduce"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license version 2 0", "mozilla public license"),
    Template("epl", "made available under the terms of the eclipse public license 2 0", "eclipse public license"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "for any purpose with or without fee is hereby granted"),
    Template("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", "altered source versions must be plainly marked"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    Template("boost", "distributed under the boost software license version 1 0", "boost software license"),
)
#: Index words of a template; votes (different words) that make a candidate, as a share of a template's index words.
INDEX_WORDS, VOTE_SHARE = 5, 0.6
#: A vote packs the template, the place plus PLACE_BASE, and the index word's number.
PLACE_BASE, WORD_BITS, PLACE_BITS = 1024, 8, 40


def normal(text: Column) -> Column:
    """The words with one space between, case kept."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SEPARATORS, " "))


def count_words(norm: Column) -> Column:
    return F.when(norm == "", 0).otherwise(F.length(norm) - F.length(F.replace(norm, F.lit(" "), F.lit(""))) + 1).cast("bigint")


def text_array(words) -> Column:
    return F.array(*[F.lit(w) for w in words]).cast("array<string>")


def document_frequencies(docs: DataFrame, templates=TEMPLATES) -> tuple[dict[str, int], int]:
    """In how many documents each template word stands, over all documents, and their number. One row a template word reaches the driver."""
    vocabulary = sorted({w for t in templates for w in t.words})
    lists = docs.select(F.array_intersect(F.split(F.lower(normal(F.col("text"))), " "), text_array(vocabulary)).alias("found"))
    rows = lists.select(F.explode(F.array_append("found", F.lit(""))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()
    counts = {r.word: r.n for r in rows}
    return counts, counts.pop("", 0)


def index_of(counts: dict[str, int], n_docs: int, templates=TEMPLATES) -> tuple[dict[str, float], list[list[tuple[str, list[int]]]]]:
    """Inverse document frequencies, and per template its rarest words with all their positions (ties: the earlier word)."""
    idf = {w: math.log((n_docs + 1) / (counts.get(w, 0) + 1)) for t in templates for w in t.words}
    index = []
    for t in templates:
        places: dict[str, list[int]] = {}
        for at, w in enumerate(t.words):
            places.setdefault(w, []).append(at)
        index.append([(w, places[w]) for w in sorted(places, key=lambda w: (-idf[w], places[w]))[:INDEX_WORDS]])
    return idf, index


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null texts count as empty, without words, places or labels; labels are then empty strings and the score 0. score is 1 with
    a base phrase, else 0.5 plus half the share of index words that agree at the best verified place, else 0. A row's
    result depends on its own text and on the document frequencies alone, so repeated rows get equal results. An empty
    table gives an empty result. Columns other than doc_id and text are not read.
    """
    counts, n_docs = document_frequencies(docs, templates)
    idf, index = index_of(counts, n_docs, templates)
    postings: dict[str, list[int]] = {}
    for t, entries in enumerate(index):
        for k, (word, places) in enumerate(entries):
            # A word at p votes for template t at place p - at, for each of its places; the same vote counts once.
            postings.setdefault(word, []).extend((t << (WORD_BITS + PLACE_BITS)) + ((PLACE_BASE - at) << WORD_BITS) + k for at in places)
    by_idf = sorted(postings, key=lambda w: (-idf[w], w))
    votes_of = F.create_map(*[x for w in by_idf for x in (F.lit(w), F.array(*[F.lit(v).cast("bigint") for v in postings[w]]))])
    needed = F.array(*[F.lit(max(1, math.ceil(VOTE_SHARE * len(e)))) for e in index])
    sizes = F.array(*[F.lit(float(len(e))) for e in index])
    labels = text_array([t.label for t in templates])
    phrases = F.array(*[text_array(t.mandatory.split()) for t in templates])
    phrase_at = F.array(*[F.lit(t.mandatory_at) for t in templates])

    norm = docs.select(F.col("doc_id"), normal(F.col("text")).alias("norm"))
    base_words = {w for _, p in PHRASES for w in p}
    met = F.arrays_overlap(F.split(F.lower("norm"), " "), text_array(sorted({*by_idf, *base_words})))
    empty = F.array().cast("array<string>")
    words = norm.select("doc_id", count_words(F.col("norm")).alias("n_words"), F.when(met, F.split(F.translate("norm", UPPER, LOWER), " ")).otherwise(empty).alias("words"))

    def ends(w: Column, i: Column) -> Column:
        """The start of a base phrase that ends with word i, if one does."""
        found = F.lit(None).cast("int")
        for _, phrase in PHRASES:
            back = len(phrase) - 1
            here = w == phrase[-1]
            for k in range(back):
                here = here & (F.get("words", i - (back - k)) == phrase[k])
            found = F.when(here, i - back).otherwise(found)
        return found

    starts = F.filter(F.transform("words", ends), lambda x: x.isNotNull())
    spaced = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    base = F.array_compact(F.array(*[F.when(spaced.contains(f" {' '.join(p)} "), F.lit(name)) for name, p in PHRASES]))
    held = F.array_intersect(text_array(by_idf), F.col("words"))
    looked = words.select("doc_id", "n_words", "words", F.when(F.array_contains("words", "license"), starts).otherwise(F.array().cast("array<int>")).alias("starts"), base.alias("base"), F.when(F.size("words") > 0, held).otherwise(empty).alias("held"))

    # Votes of one place stand together once sorted; a place that reaches its template's number is noted.
    cast = F.flatten(F.filter(F.transform("words", lambda w, i: F.when(F.array_contains("held", w), F.transform(votes_of[w], lambda v: v + i.cast("bigint") * (1 << WORD_BITS)))), lambda x: x.isNotNull()))
    voted = looked.withColumn("votes", F.when(F.size("held") > 0, F.sort_array(F.array_distinct(cast))).otherwise(F.array().cast("array<bigint>")))
    template_of = lambda v: F.shiftright(v, WORD_BITS + PLACE_BITS).cast("int")
    place_of = lambda v: (F.shiftright(v, WORD_BITS).bitwiseAND(F.lit((1 << PLACE_BITS) - 1)) - PLACE_BASE).cast("int")
    nothing = F.struct(F.lit(-1).cast("bigint").alias("group"), F.lit(0).alias("n"), F.array().cast("array<struct<vote:bigint,n:int>>").alias("found"))

    def count(state: Column, vote: Column) -> Column:
        group = F.shiftright(vote, WORD_BITS)
        n = F.when(state["group"] == group, state["n"] + 1).otherwise(1)
        enough = n >= F.get(needed, template_of(vote))
        return F.struct(group.alias("group"), n.alias("n"), F.when(enough, F.array_append(state["found"], F.struct(vote.alias("vote"), n.alias("n")))).otherwise(state["found"]).alias("found"))

    candidates = F.aggregate("votes", nothing, count, lambda s: s["found"])
    counted = voted.withColumn("candidates", F.when(F.size("votes") > 0, candidates).otherwise(F.array().cast("array<struct<vote:bigint,n:int>>")))

    def verified(c: Column) -> Column:
        t, at = template_of(c["vote"]), place_of(c["vote"]) + F.get(phrase_at, template_of(c["vote"]))
        phrase = F.get(phrases, t)
        return (at >= 0) & (F.slice("words", F.greatest(at, F.lit(0)) + 1, F.size(phrase)) == phrase)

    kept = counted.withColumn("kept", F.filter("candidates", verified))
    own = F.transform("kept", lambda c: F.get(labels, template_of(c["vote"])))
    best = F.coalesce(F.array_max(F.transform("kept", lambda c: c["n"] / F.get(sizes, template_of(c["vote"])))), F.lit(0.0))
    score = F.when(F.size("base") > 0, 1.0).when(F.size("kept") > 0, 0.5 + 0.5 * best).otherwise(0.0)
    return kept.select(
        "doc_id", "n_words", F.size("starts").cast("bigint").alias("n_base"),
        F.array_min("starts").cast("bigint").alias("first_word"), F.array_max("starts").cast("bigint").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", own))), ",").alias("labels"),
        score.cast("double").alias("score"),
    )
