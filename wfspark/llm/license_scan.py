"""License scan by diagonal voting, in DataFrame operations only.

Every rolling word 3-gram of a document is hashed and joined with the places of the same 3-gram in the templates; its words are compared too. A match
votes for the diagonal `place in document - place in template`. Diagonals that lie next to each other (words put in or left out)
merge into one span. A span is verified by its words: those template words count, each once, that stand in the document on one of the span's
diagonals as part of an equal 3-gram. A span that covers enough of its template, and isn't much longer, gives the template's label. A base phrase stands
where one diagonal has the vote of each of its 3-grams.

The table of template 3-grams goes to every task up to ``MOST_PLACES`` rows; 3-grams that match nothing go no further than the task
that made them. Null and empty texts have no words, no labels and score 0. Rows with one doc_id are one
document: a place found in several of them counts once, n_words is the most. Texts of any length are read whole. Spans of several templates, equal or
overlapping, count each. Extra columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wfspark.llm.native_words import grams, small_enough, words

K = 3
NEAR = 2
LEAST_COVER = 0.8
MOST_PLACES = 2_000_000

#: Phrases whose places are counted, with their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Further templates: well-known sentences of licenses and of license notices.
TEMPLATES = {
    "licensed under the gnu general public license version 3": "gpl-3",
    "licensed under the gnu general public license version 2": "gpl-2",
    "under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "licensed under the gnu lesser general public license": "lgpl",
    "licensed under the gnu affero general public license": "agpl",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "licensed under the apache license version 2 0": "apache-2",
    "subject to the terms of the mozilla public license": "mpl-2",
    "licensed under a creative commons attribution noncommercial": "cc-by-nc",
    "licensed under cc by sa": "cc-by-sa",
    "creative commons attribution sharealike": "cc-by-sa",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
}


def template_rows() -> list[tuple[int, str, str, bool]]:
    """Number, words, label and whether it is a base phrase."""
    every = [(text, label, True) for text, label in BASE.items()] + [(text, label, False) for text, label in TEMPLATES.items()]
    return [(k, *row) for k, row in enumerate(every)]


def license_scan(docs: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and n_spans. ``templates``: template (a number), phrase, label and
    is_base, for instance full license texts; phrases of fewer than three words can't be found."""
    if templates is None:
        templates = docs.sparkSession.createDataFrame(template_rows(), "template int, phrase string, label string, is_base boolean")
    parts = templates.select("template", "label", "is_base", words(F.col("phrase")).alias("template_words")).where(F.size("template_words") >= K)
    parts = parts.withColumn("n_grams", F.size("template_words") - (K - 1))
    text = lambda array, at: F.array_join(F.slice(array, at, K), " ")
    places = parts.select("template", "template_words", F.posexplode(grams(F.col("template_words"), K)).alias("at", "gram"))
    places = places.select("template", "at", "gram", text("template_words", F.col("at") + 1).alias("gram_text"))
    told = parts.select(F.col("template").alias("of"), "label", "is_base", "n_grams")

    read = docs.select("doc_id", words(F.col("text")).alias("words"))
    # each document's word count goes along as one more entry, so the texts are read once
    own = read.select("doc_id", "words", F.size("words").alias("n_words"), grams(F.col("words"), K).alias("grams"))
    rows = own.select("doc_id", "words", F.posexplode(F.concat(F.array(F.col("n_words").cast("bigint")), "grams")).alias("k", "value"))
    met = rows.join(F.broadcast(places) if small_enough(places, MOST_PLACES) else places, (F.col("k") > 0) & (F.col("gram") == F.col("value")), "left")
    # words are compared after the join, for matches only
    found = met.where((F.col("k") == 0) | (F.col("gram_text") == text("words", F.greatest(F.col("k"), F.lit(1)))))
    votes = found.groupBy("doc_id", "template", (F.col("k") - 1 - F.col("at")).alias("diagonal")).agg(
        F.collect_set("at").alias("places"), F.max(F.when(F.col("k") == 0, F.col("value"))).alias("n_words"), F.min("k").alias("low"), F.max("k").alias("high")
    )
    along = Window.partitionBy("doc_id", "template").orderBy("diagonal")
    votes = votes.join(F.broadcast(told), F.col("template") == F.col("of"), "left")
    stands = F.col("is_base") & (F.size("places") == F.col("n_grams"))
    covered = F.array_distinct(F.flatten(F.transform(F.flatten(F.collect_list("places")), lambda at: F.sequence(at, at + (K - 1)))))
    spans = (
        votes.withColumn("apart", F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > NEAR, F.lit(True)).cast("int"))
        .withColumn("span", F.sum("apart").over(along))
        .groupBy("doc_id", "template", "span")
        .agg(
            F.max("n_words").alias("n_words"),
            F.first("label").alias("label"),
            (F.size(covered) / (F.first("n_grams") + (K - 1))).alias("cover"),
            (F.max("high") - F.min("low") + K <= 1.5 * (F.first("n_grams") + K - 1) + NEAR).alias("is_close"),
            F.sum(F.when(stands, 1)).alias("n_base"),
            F.min(F.when(stands, F.col("diagonal"))).alias("first_word"),
            F.max(F.when(stands, F.col("diagonal"))).alias("last_word"),
        )
    )
    good = F.col("is_close") & (F.col("cover") >= LEAST_COVER)
    is_base = F.col("n_base") > 0
    sorted_labels = lambda when: F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("label")))), ",")
    return spans.groupBy("doc_id").agg(
        F.max("n_words").alias("n_words"),
        F.coalesce(F.sum("n_base"), F.lit(0)).alias("n_base"),
        F.min("first_word").cast("bigint").alias("first_word"),
        F.max("last_word").cast("bigint").alias("last_word"),
        sorted_labels(is_base).alias("base_labels"),
        sorted_labels(is_base | good).alias("labels"),
        F.coalesce(F.max(F.when(is_base, F.lit(1.0)).when(F.col("is_close"), F.col("cover"))), F.lit(0.0)).alias("score"),
        F.count(F.when(is_base | good, 1)).alias("n_spans"),
    )
