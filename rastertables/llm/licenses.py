"""License scans by diagonal voting.

Templates are license notices and phrases as sequences of words.  All rolling runs
of K words of every text are hashed and joined with the places of the same runs
in the templates.  A hit votes for its diagonal, the text's place minus the template's:
a notice that stands in a text puts all its votes on one diagonal.  Words that were put in
or left out move the rest of the notice to a neighbouring diagonal, so diagonals within
``slack`` of each other are merged.  A span is verified by its words: hits count only
where the words themselves are equal, and a span only where they cover enough of the
template's words.

Phrases are templates that must match as a whole, on one diagonal.

Everything is built from DataFrame functions.  Templates are few and fixed and are
broadcast; texts are exploded and probed in the task that reads them, and only
hits and one narrow row per text are shuffled, by text.

Defined cases: a null text is the empty text: no words, no places, empty labels, score 0;
rows are told by number, so null and repeated doc_ids keep a row each, and rows that repeat
have the same result; a template that two labels share counts for both; no rows give no
rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of a run; phrases that are shorter are one run.
K = 3
#: Diagonals that are merged, and the share of a template's words that a span must cover.
SLACK, COVER = 6, 0.75
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words; A-Z are lower-cased after.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: The phrases of the contract and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Sentences that public licenses ask to be kept, as (label, text).
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]


def words(text: Column) -> Column:
    """The words of a text, A-Z not yet lower-cased."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda w: w != "")


def runs(rows: DataFrame, of: str, k: int = K) -> DataFrame:
    """``rows`` with a row for each place of array ``of``: pos and the words w0 to w<k-1>
    from there (null after the end).  The word columns are the same array, moved."""
    moved = [F.slice(of, j + 1, F.greatest(F.size(of) - j, F.lit(0))) for j in range(k)]
    out = rows.select(*[c for c in rows.columns if c != of], F.posexplode(F.arrays_zip(*[m.alias(f"w{j}") for j, m in enumerate(moved)])).alias("pos", "at"))
    return out.select("*", *[F.col("at")[f"w{j}"].alias(f"w{j}") for j in range(k)]).drop("at")


def run_hash(parts: list[Column]) -> Column:
    return F.xxhash64(F.lit(len(parts)), *[F.lower(p) for p in parts])


def template_runs(phrases: dict[str, str], notices: list[tuple[str, str]]) -> list[tuple]:
    """(run, template, at, width, length, label, whole) for each run of each template."""
    out = []
    for template, (text, label, whole) in enumerate([*((x, label, True) for x, label in phrases.items()), *((x, label, False) for label, x in notices)]):
        ws = [w for w in re.split(SEPARATORS, text.translate(str.maketrans(UPPER, LOWER))) if w]
        width = min(K, len(ws))
        out += [(" ".join(ws[at : at + width]), template, at, width, len(ws), label, whole) for at in range(len(ws) - width + 1) if ws]
    return out


def templates(spark: SparkSession, given: list[tuple]) -> DataFrame:
    """``template_runs`` as a table with the hash of each run."""
    names = ["run", "template", "at", "width", "length", "label", "whole"]
    each = spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, t, strict=True)]) for t in given])))
    parts = [F.get(F.split("run", " "), F.lit(j)) for j in range(K)]
    chosen = F.when(F.col("width") == K, run_hash(parts))
    for k in range(1, K):
        chosen = chosen.when(F.col("width") == k, run_hash(parts[:k]))
    return each.withColumn("hash", chosen)


def hits(docs: DataFrame, phrases: dict[str, str], notices: list[tuple[str, str]]) -> DataFrame:
    """row, doc_id and n_words of every text once with a null template, and for each run that
    stands in a template its place and the template's."""
    given = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words(F.col("text")).alias("ws"))
    given = given.withColumn("n_words", F.size("ws").cast("long"))
    # The first element stands for the text itself and has no words.
    given = given.withColumn("ws", F.concat(F.array(F.lit(None).cast("string")), "ws"))
    parts = [F.col(f"w{j}") for j in range(K)]
    known = template_runs(phrases, notices)
    widths = sorted({t[3] for t in known})
    hashes = F.array(*[F.when(parts[0].isNotNull() & parts[k - 1].isNotNull(), run_hash(parts[:k])) for k in widths])
    probes = runs(given, "ws").select("*", F.explode(F.when(F.col("pos") == 0, F.array(F.lit(None).cast("long"))).otherwise(hashes)).alias("hash"))
    probes = probes.filter(F.col("hash").isNotNull() | (F.col("pos") == 0))
    met = probes.join(F.broadcast(templates(docs.sparkSession, known)), "hash", "left").filter(F.col("template").isNotNull() | (F.col("pos") == 0))
    # Hashes and lower() only propose; the words decide.
    text = F.concat_ws(" ", *[F.when(F.col("width") > j, p) for j, p in enumerate(parts)])
    met = met.filter((F.col("pos") == 0) | (F.translate(text, UPPER, LOWER) == F.col("run")))
    return met.select("row", "doc_id", "n_words", (F.col("pos") - 1).alias("pos"), "template", "at", "width", "length", "label", "whole")


def diagonals(found: DataFrame) -> DataFrame:
    """One row for each text, template and diagonal: its votes as the sorted places in
    the template (at most as many as the template has), and full: whether all are there."""
    per = found.groupBy("row", "template", (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.sort_array(F.collect_list("at")).alias("places"), F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        F.first("width").alias("width"), F.first("length").alias("length"), F.first("label").alias("label"), F.first("whole").alias("whole"),
    )
    return per.withColumn("full", F.size("places") == F.col("length") - F.col("width") + 1)


def _covered(places: Column, width: Column) -> Column:
    """How many words of the template the runs at these places cover."""
    return F.size(F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(p, p + width - 1)))))


def spans(diagonals: DataFrame, slack: int = SLACK) -> DataFrame:
    """``diagonals`` with cover: the share of the template's words that the diagonal and its
    neighbours within ``slack`` cover; a phrase has no neighbours: it is there or not."""
    near = Window.partitionBy("row", "template").orderBy("diagonal").rangeBetween(-slack, slack)
    merged = F.array_distinct(F.flatten(F.collect_list("places").over(near)))
    share = _covered(F.col("merged"), F.col("width")) / F.col("length")
    out = diagonals.withColumn("merged", merged)
    return out.withColumn("cover", F.when(F.col("whole"), F.col("full").cast("double")).otherwise(share)).drop("merged")


def verified(spans: DataFrame, cover: float = COVER, slack: int = SLACK) -> DataFrame:
    """row, doc_id, label, template, first_word, last_word, cover: the spans that cover enough
    of their template, each by its strongest diagonal (of equal ones the first)."""
    near = Window.partitionBy("row", "template").orderBy("diagonal").rangeBetween(-slack, slack)
    best = F.max(F.struct("cover", F.size("places").alias("n"), (-F.col("diagonal")).alias("d"))).over(near)
    own = spans.filter(F.col("template").isNotNull() & (F.col("cover") >= cover)).withColumn("best", best)
    own = own.filter(F.col("whole") | (-F.col("best")["d"] == F.col("diagonal")))
    start = F.col("diagonal") + F.get("places", F.lit(0))
    return own.select("row", "doc_id", "label", "template", start.alias("first_word"), (F.col("diagonal") + F.element_at("places", -1) + F.col("width") - 1).alias("last_word"), "cover")


def _listed(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def scan_spans(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """The verified spans of all texts."""
    return verified(spans(diagonals(hits(docs, phrases, notices))))


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: list[tuple[str, str]] = NOTICES, cover: float = COVER) -> DataFrame:
    """One row per text: doc_id, n_words, n_base (places where a phrase stands), first_word
    and last_word (their least and largest start), base_labels, labels (also of notices),
    score (the largest share of a template that the text covers)."""
    # All further steps group by text: one shuffle of the hits serves them.
    found = hits(docs, phrases, notices).repartition("row")
    each = spans(diagonals(found))
    base = F.col("whole") & F.col("full")
    return (
        each.groupBy("row").agg(
            F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.count_if(base).alias("n_base"),
            F.min(F.when(base, F.col("diagonal"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("diagonal"))).cast("long").alias("last_word"),
            _listed(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"), _listed(F.collect_set(F.when(F.col("cover") >= cover, F.col("label")))).alias("labels"),
            F.coalesce(F.max("cover"), F.lit(0.0)).alias("score"),
        ).drop("row")
    )
