"""License scan by diagonal voting.

Every rolling word 3-gram of every text is joined to the positions of the same 3-gram in
the license templates (a fixed, small table).  A match votes for the diagonal
``text position - template position``; votes are counted per text, template and diagonal.
Diagonals within ``DRIFT`` of each other are merged (a word more or less moves the rest by
one).  As the drift of a whole span is bounded, its votes stand in the template's order but
for ``DRIFT`` words, and scattered or repeated pieces of a notice cannot add up.  The span
is verified by the share of distinct template positions it accounts for and by the words
that tell a license from its rivals.  Of overlapping spans the best one stays.  Joining on the 3-gram itself beside its hash makes every vote exact.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rangeloom.llm.common import require

K = 3
#: The diagonals of a span differ by so much at most.
DRIFT = 12
#: Share of a template's 3-grams that a span must account for.
COVERAGE = 0.6
SPLIT = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

#: Exact phrases and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: Notices of well-known licenses and their labels.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("all-rights-reserved", "all rights reserved no part of this publication may be reproduced"),
    # Short notices: of fewer than WHOLE 3-grams, so they must occur whole.
    ("all-rights-reserved", "all rights reserved"),
    ("apache-2", "licensed under the apache license version 2"),
    ("bsd", "licensed under the bsd license"),
    ("bsd", "under the bsd 2 clause license"),
    ("bsd", "under the bsd 3 clause license"),
    ("gpl", "licensed under the gnu general public license"),
    ("gpl", "under the gnu gpl"),
    ("gpl", "gnu general public license version 2"),
    ("gpl", "gnu general public license version 3"),
    ("gpl", "gnu general public license v2"),
    ("gpl", "gnu general public license v3"),
    ("lgpl", "gnu lesser general public license"),
    ("mpl-2", "mozilla public license version 2"),
    ("mpl-2", "mozilla public license v 2"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "creative commons attribution 4 0"),
    ("cc-by", "creative commons attribution license"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("cc-by-sa", "cc by sa"),
    ("cc-by-nc-sa", "creative commons attribution noncommercial sharealike"),
)
#: Words that a span must hold where its template does.
TELLING = ("lesser", "noncommercial", "sharealike")
#: A template of fewer 3-grams must be met whole.
WHOLE = 9


def template_words(text: str) -> list[str]:
    return [w for w in re.split(SPLIT, text.translate({i: i + 32 for i in range(0x41, 0x5B)})) if w]


def template_rows(phrases, templates) -> list[tuple[int, str, int, int, str, bool, list[list[int]]]]:
    """(template, gram, position, grams of the template, label, exact, needs) for every 3-gram;
    ``needs`` are the positions of each telling word's 3-grams."""
    rows = []
    for t, (label, text, exact) in enumerate([(lb, tx, True) for tx, lb in phrases] + [(lb, tx, False) for lb, tx in templates]):
        words = template_words(text)
        if len(words) < K:
            raise ValueError(f"a template needs {K} words: {text!r}")
        grams = [" ".join(words[i : i + K]) for i in range(len(words) - K + 1)]
        needs = [[i for i, g in enumerate(grams) if word in g.split()] for word in TELLING if word in words]
        rows += [(t, g, i, len(grams), label, exact, needs) for i, g in enumerate(grams)]
    return rows


def scan_licenses(df: DataFrame, key: str = "doc_id", text: str = "text", phrases=PHRASES, templates=TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """One row per input row: key, n_words, n_base, first_word, last_word, base_labels, labels,
    score and ``spans`` (label, first word, words, share of the template).

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.  Base places are
    the exact phrases.  The score is the best span's share, 0 without a span.  Null and empty texts have no words and no labels (empty strings),
    score 0; copies and repeated rows each get their result.
    """
    require(df, key, text)
    spark = df.sparkSession
    plan = spark.createDataFrame(template_rows(phrases, templates), "tmpl int, gram string, tpos int, grams int, label string, exact boolean, needs array<array<int>>")
    plan = F.broadcast(plan.select(F.xxhash64("gram").alias("t_hash"), F.col("gram").alias("t_gram"), "tmpl", "tpos", "grams", "label", "exact", "needs"))  # fixed table
    # Two code points above U+007F have an ASCII letter in their lower-case form; neither may make an ASCII word.
    t = F.lower(F.replace(F.replace(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit("K"), F.lit("é")), F.lit("İ"), F.lit("é")))
    words = df.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("key"), F.array_remove(F.split(t, SPLIT, -1), "").alias("w"))
    n = F.size("w")
    gram = lambda i: F.concat_ws(" ", *[F.get("w", i + j) for j in range(K)])
    grams = F.when(n < K, F.expr("cast(array() as array<struct<pos:int,gram:string>>)")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(n - K, F.lit(0))), lambda i: F.struct(i.alias("pos"), gram(i).alias("gram")))
    )
    # The first element stands for the text itself and carries its number of words, as -1 - n.
    own = F.array(F.struct((F.lit(-1) - n).alias("pos"), F.lit("").alias("gram")))
    rolled = words.select("row", "key", F.inline(F.concat(own, grams)))
    met = rolled.join(plan, (F.xxhash64("gram") == F.col("t_hash")) & (F.col("gram") == F.col("t_gram")), "left").where("pos < 0 or tmpl is not null")
    votes = met.groupBy("row", "key", "tmpl", (F.col("pos") - F.coalesce("tpos", F.lit(0))).alias("diag")).agg(
        F.collect_set("tpos").alias("at"), F.first("needs").alias("needs"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.first("grams").alias("grams"), F.first("label").alias("label"), F.first("exact").alias("exact")
    )
    # Every diagonal opens a span of the diagonals up to DRIFT behind it, at most DRIFT + 1 rows.
    near_by = Window.partitionBy("row", "tmpl").orderBy("diag").rangeBetween(0, DRIFT)
    merged = lambda whole, one: F.when(F.col("exact") | F.col("tmpl").isNull(), F.col(one)).otherwise(whole)
    spans = votes.select(
        "row", "key", "tmpl", "diag", "needs", "grams", "label", "exact",
        merged(F.array_distinct(F.flatten(F.collect_list("at").over(near_by))), "at").alias("at"),
        merged(F.min("first").over(near_by), "first").alias("first"),
        merged(F.max("last").over(near_by), "last").alias("last"),
    )
    spans = spans.withColumn("votes", F.size("at"))
    share = F.col("votes") / F.col("grams")
    base = F.col("exact") & (F.col("votes") == F.col("grams"))
    near = ~F.col("exact") & (share >= F.when(F.col("grams") < WHOLE, F.lit(1.0)).otherwise(F.lit(coverage))) & F.forall("needs", lambda p: F.arrays_overlap(p, F.col("at")))
    span = F.struct(share.alias("share"), "votes", (-F.col("tmpl")).alias("order"), "label", F.col("first").alias("word"), (F.col("last") - F.col("first") + K).alias("n"))
    found = spans.groupBy("row", "key").agg(
        (F.lit(-1) - F.min(F.when(F.col("tmpl").isNull(), F.col("diag")))).cast("long").alias("n_words"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("diag"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("diag"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.collect_list(F.when(base, span)).alias("exacts"),
        F.sort_array(F.collect_list(F.when(near, span)), asc=False).alias("nears"),
    )
    # Adjoining notices of one label do not compete, two spans of one template do.
    rival = lambda a, b: ((a["label"] != b["label"]) | (a["order"] == b["order"])) & (a["word"] < b["word"] + b["n"]) & (b["word"] < a["word"] + a["n"])
    best = F.aggregate("nears", F.slice("nears", 1, 0), lambda kept, c: F.when(F.exists(kept, lambda o: rival(o, c)), kept).otherwise(F.concat(kept, F.array(c))))
    found = found.withColumn("best", F.concat("exacts", best))
    found = found.select(
        "*",
        F.array_join(F.array_sort(F.array_distinct(F.transform("best", lambda s: s["label"]))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("best", lambda s: s["share"])), F.lit(0.0)).alias("score"),
        F.array_sort(F.transform("best", lambda s: F.struct(s["label"].alias("label"), s["word"].alias("word"), s["n"].alias("n"), s["share"].alias("share")))).alias("spans"),
    )
    return found.select(F.col("key").alias(key), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
