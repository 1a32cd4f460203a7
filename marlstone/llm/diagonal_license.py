"""License scans by diagonal voting.

All rolling word k-grams of a text are coded over the templates' vocabulary and
joined, in Spark, to the positions of equal k-grams in the license templates. A
hit votes for the diagonal ``text position - template position``; a diagonal
merges with its neighbours up to ``SLACK`` words further, so inserted, dropped
and changed words don't break a span. A span is verified by the words of the
template that its hits cover, each word counted once: repeats of one k-gram
can't stand in for missing words. A word weighs less the more templates have it,
so one that tells licenses apart is missed more than a common one. Phrases that tell a license from its relatives
(name, variant, version: TELLING) must stand whole, on one diagonal each: a text that names another version or
variant is no span of this one. Of overlapping spans of a template the one
that covers most stays. The score is the best span's coverage; a phrase without a span leaves the license
open and scores PHRASE. Codes are exact (a k-gram's words can be read back from
its code), so a hit proves equal words. K-grams with a word outside the
vocabulary can't equal a template's and are left out before the join. Templates
of any length are a parameter; short ones use pairs of words, so that one
changed word leaves enough of them.

Defined results: null and empty texts have no words and empty labels; repeated
rows and null identifiers give rows of their own; overlapping places all count;
very long texts are read whole; an empty table gives an empty table; extra
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_table, cut, filled, map_pieces, split_words, translated

#: Phrases whose every place counts, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Sentences of widely used public licenses, with their labels.
TEMPLATES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache-2.0",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-notice",
    "under the terms of the gnu lesser general public license": "lgpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "this work is licensed under a creative commons attribution license": "creative-commons",
    "this work is licensed under the gnu general public license version 2": "gpl-2.0",
    "this work is licensed under the gnu affero general public license version 3": "agpl-3.0",
    "licensed under cc by 4 0": "cc-by-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "licensed under cc by nd 4 0": "cc-by-nd-4.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by nc sa 4 0": "cc-by-nc-sa-4.0",
    "licensed under cc by nc nd 4 0": "cc-by-nc-nd-4.0",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4.0",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa-4.0",
    "this work is licensed under a creative commons attribution noderivatives 4 0 international license": "cc-by-nd-4.0",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc-4.0",
    "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license": "cc-by-nc-sa-4.0",
    "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license": "cc-by-nc-nd-4.0",
}

#: Phrases by label: in a template of the label, each that it contains must stand whole.
TELLING = {
    "apache-2.0": ("apache", "version 2 0"),
    "mit": ("mit license",),
    "gpl-3.0": ("gnu general public license", "version 3"),
    "gpl-2.0": ("gnu general public license", "version 2"),
    "gpl-notice": ("gnu general public license",),
    "agpl-3.0": ("affero general public license", "version 3"),
    "lgpl": ("lesser general public license",),
    "mpl-2.0": ("mozilla public license", "v 2 0"),
    "creative-commons": ("creative commons attribution license",),
    "cc-by-4.0": ("cc", "by 4 0", "commons attribution 4 0 international"),
    "cc-by-sa-4.0": ("cc", "by sa 4 0", "commons attribution sharealike 4 0 international"),
    "cc-by-nd-4.0": ("cc", "by nd 4 0", "commons attribution noderivatives 4 0 international"),
    "cc-by-nc-4.0": ("cc", "nc 4 0", "commons attribution noncommercial 4 0 international"),
    "cc-by-nc-sa-4.0": ("cc", "nc sa 4 0", "commons attribution noncommercial sharealike 4 0 international"),
    "cc-by-nc-nd-4.0": ("cc", "nc nd 4 0", "commons attribution noncommercial noderivatives 4 0 international"),
}

#: Words of a k-gram, and of a k-gram in templates of at most SHORT words; phrases use their own length.
K, SHORT_K, SHORT = 3, 2, 12
#: Diagonals at most so far apart merge; a span needs this share of its template's words by weight.
SLACK, COVER = 8, 0.7
#: Score of a base phrase alone.
PHRASE = 0.5
_WORD_BITS = 20
_WORDS = byte_table("abcdefghijklmnopqrstuvwxyz0123456789")


class Templates:
    """Vocabulary and k-gram positions of phrases and templates."""

    def __init__(self, base: dict[str, str] = BASE, templates: dict[str, str] = TEMPLATES, telling: dict[str, tuple[str, ...]] = TELLING):
        self.rows: list[tuple[int, int, int]] = []  # code, template, position
        # template, label, base, k, weights of its words (their sum is 1), first and last word of its telling phrases
        self.labels: list[tuple[int, str, bool, int, list[float], list[tuple[int, int]]]] = []
        words = [(text.split(), label, True) for text, label in base.items()] + [(text.split(), label, False) for text, label in templates.items()]
        self.vocabulary = sorted({w for ws, _, _ in words for w in ws})
        number = {w: i + 1 for i, w in enumerate(self.vocabulary)}
        among = Counter(w for ws, _, is_base in words if not is_base for w in set(ws))
        self.sizes: set[int] = set()
        for t, (ws, label, is_base) in enumerate(words):
            own = min(len(ws), len(ws) if is_base else SHORT_K if len(ws) <= SHORT else K)
            self.sizes.add(own)
            for at in range(len(ws) - own + 1):
                self.rows.append((self.code([number[w] for w in ws[at : at + own]]), t, at))
            weights = [1 / max(1, among[w]) for w in ws]
            phrases = [] if is_base else [p.split() for p in telling.get(label, ())]
            places = [next((i for i in range(len(ws) - len(p) + 1) if ws[i : i + len(p)] == p), None) for p in phrases]
            runs = [(at, at + len(p) - 1) for at, p in zip(places, phrases, strict=True) if at is not None]
            self.labels.append((t, label, is_base, own, [x / sum(weights) for x in weights], runs))
        if max(self.sizes) > 3:
            raise ValueError("phrases of over three words belong to the templates")

    @staticmethod
    def code(numbers: list[int]) -> int:
        total = 0
        for n in numbers:
            total = total << _WORD_BITS | n
        return total


def kgrams(docs: DataFrame, templates: Templates) -> DataFrame:
    """_row (unique), doc_id, n_words and the coded k-grams of every text."""
    vocabulary, sizes = pa.array(templates.vocabulary, pa.string()), sorted(templates.sizes)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n = batch.num_rows
        words, rows = split_words(translated(filled(batch.column(1)), _WORDS))
        count = np.bincount(rows, minlength=n)
        position = np.arange(len(rows)) - (np.cumsum(count) - count)[rows]
        number = pc.fill_null(pc.index_in(words, value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        at, where, codes = [], [], []
        for k in sizes:
            if len(number) < k:
                continue
            windows = np.lib.stride_tricks.sliding_window_view(number, k)
            full = np.flatnonzero((windows > 0).all(axis=1) & (rows[: len(rows) - k + 1] == rows[k - 1 :]))
            code = np.zeros(len(full), np.int64)
            for j in range(k):
                code = code << _WORD_BITS | windows[full, j]
            at.append(rows[full])
            where.append(position[full])
            codes.append(code)
        at, where, codes = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at, where, codes))
        order = np.argsort(at, kind="stable")
        offsets = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=n))]).astype(np.int32)
        grams = pa.StructArray.from_arrays([pa.array(where[order].astype(np.int32)), pa.array(codes[order])], names=["pos", "code"])
        yield pa.record_batch(
            [batch.column(0), pa.array(count.astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), grams)], names=["doc_id", "n_words", "grams"]
        )

    rows = map_pieces(docs.selectExpr("cast(doc_id as long) doc_id", "text"), work, "doc_id long, n_words long, grams array<struct<pos: int, code: long>>")
    return rows.withColumn("_row", F.monotonically_increasing_id())


def spans(grams: DataFrame, templates: Templates, slack: int = SLACK, cover: float = COVER) -> DataFrame:
    """Verified spans: _row, label, base, first and last word, coverage."""
    spark = grams.sparkSession
    # Both tables are as large as the templates, a few hundred rows.
    places = F.broadcast(spark.createDataFrame(templates.rows, "code long, template int, at int"))
    labels = F.broadcast(spark.createDataFrame(templates.labels, "template int, label string, base boolean, k int, weights array<double>, runs array<struct<lo: int, hi: int>>"))
    hits = grams.select("_row", F.inline("grams")).join(places, "code").withColumn("diagonal", F.col("pos") - F.col("at"))
    # A diagonal has each position of the template once at most.
    votes = hits.groupBy("_row", "template", "diagonal").agg(F.collect_set("at").alias("at"), F.min("pos").alias("first"), F.max("pos").alias("last")).join(labels, "template")
    exact = votes.where("base").select("_row", "label", "base", "first", (F.col("last") + F.col("k") - 1).alias("last"), F.lit(PHRASE).alias("coverage"))
    along = Window.partitionBy("_row", "template").orderBy("diagonal")
    near = along.rangeBetween(0, slack)
    covered = F.array_distinct(F.flatten(F.transform(F.flatten(F.collect_list("at").over(near)), lambda a: F.sequence(a, a + F.col("k") - 1))))
    weight = F.aggregate(covered, F.lit(0.0), lambda total, at: total + F.get("weights", at))
    # One bit for each telling phrase that this diagonal has whole.
    own = votes.where("not base").withColumn("_own", F.array_distinct(F.flatten(F.transform("at", lambda a: F.sequence(a, a + F.col("k") - 1)))))
    whole = F.transform("runs", lambda r, i: F.when(F.size(F.filter("_own", lambda p: p.between(r["lo"], r["hi"]))) == r["hi"] - r["lo"] + 1, F.pow(F.lit(2), i)).otherwise(0).cast("long"))
    stand = own.withColumn("_stand", F.aggregate(whole, F.lit(0).cast("long"), lambda total, bit: total + bit))
    merged = stand.withColumns({"_stand": F.bit_or("_stand").over(near), "coverage": F.least(F.lit(1.0), F.round(weight, 9)), "first": F.min("first").over(near), "last": F.max("last").over(near) + F.col("k") - 1})
    found = merged.where((F.col("coverage") >= cover) & (F.col("_stand") == F.pow(F.lit(2), F.size("runs")).cast("long") - 1) & (F.col("last") - F.col("first") < F.size("weights") + 2 * slack))
    # Neighbouring diagonals find the same place again: the best of each run of them stays.
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > slack, F.lit(True))
    runs = found.withColumn("_run", F.sum(apart.cast("int")).over(along)).groupBy("_row", "template", "_run", "label")
    best = runs.agg(F.max(F.struct("coverage", (-F.col("diagonal")).alias("d"), "first", "last")).alias("s"))
    return exact.unionByName(best.select("_row", "label", F.lit(False).alias("base"), "s.first", "s.last", "s.coverage"))


def scan(docs: DataFrame, base: dict[str, str] = BASE, templates: dict[str, str] = TEMPLATES, telling: dict[str, tuple[str, ...]] = TELLING) -> DataFrame:
    """Per row: words, base places with their first and last start, base labels, all labels, score."""
    known = Templates(base, templates, telling)
    grams = cut(kgrams(docs, known))
    found = spans(grams, known).groupBy("_row").agg(
        F.count(F.when(F.col("base"), 1)).alias("n_base"),
        F.min(F.when(F.col("base"), F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("first"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("coverage").alias("score"),
    )
    out = grams.select("_row", "doc_id", "n_words").join(found, "_row", "left")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
