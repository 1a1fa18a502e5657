"""License scans by diagonal voting, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import publish

PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)
GRAM = 2
GAP = 3
COVER = 0.7


def license_words(text: Column) -> Column:
    """Words of ASCII letters and digits and of all characters beyond ASCII, in lower case.

    lower() also maps letters beyond ASCII. They stay word characters, so words and counts are those of lower-casing
    A-Z alone; the one letter that it maps to an ASCII letter alone, the Kelvin sign, occurs in no phrase as k.
    """
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def template_grams(spark: SparkSession, templates) -> DataFrame:
    """(gram hash, gram, template, label, position, words, base): one row per template position."""
    rows = []
    for number, (label, text, base) in enumerate(templates):
        words = text.split()
        rows += [(" ".join(words[i : i + GRAM]), number, label, i, len(words), base) for i in range(len(words) - GRAM + 1)]
    frame = spark.createDataFrame(rows, "t_gram string, template int, label string, t_pos int, t_words int, base boolean")
    return frame.withColumn("t_hash", F.xxhash64("t_gram"))


def aligned_words(hits: Column, reach: Column) -> Column:
    """The most template words that an ordered run of the hits (pos, t, by pos and falling t) covers.

    Along a run both places rise, and the diagonal changes by GAP at most from hit to hit, so the span stays about
    as long as the template. Only hits at most `reach` words before can be the one before in a run.
    """
    state = F.struct(F.array().cast("array<struct<pos:int,t:int,words:int>>").alias("recent"), F.lit(0).alias("most"))

    def step(state: Column, hit: Column) -> Column:
        before = F.filter(
            state["recent"], lambda r: (r["t"] < hit["t"]) & (r["pos"] < hit["pos"]) & (F.abs(hit["pos"] - r["pos"] - hit["t"] + r["t"]) <= GAP)
        )
        words = F.coalesce(F.array_max(F.transform(before, lambda r: r["words"] + F.least(F.lit(GRAM), hit["t"] - r["t"]))), F.lit(GRAM))
        here = F.array(F.struct(hit["pos"].alias("pos"), hit["t"].alias("t"), words.alias("words")))
        recent = F.concat(F.filter(state["recent"], lambda r: r["pos"] >= hit["pos"] - reach), here)
        return F.struct(recent.alias("recent"), F.greatest(state["most"], words).alias("most"))

    return F.aggregate(hits, state, step, lambda state: state["most"])


def scan_licenses(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, cover: float = COVER) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Every rolling word 2-gram is joined by hash to the template positions (a fixed list, so its broadcast is
    bounded) and compared with the template's own words. Matches vote for their diagonal, the document position
    less the template position. A base phrase stands where one diagonal has all its votes. For templates,
    diagonals at most GAP apart are merged. A merged span whose votes could cover the share `cover` of the template's
    words is verified: an ordered run of its hits has to cover that share. Score is the best verified cover of a
    template, 1 for a base phrase, else 0. The votes are written once and read for both.

    Null text is empty; null ids and repeated rows get rows of their own; other columns are ignored. An empty table
    gives no rows. Very long texts are rolled whole; a hit costs the hits of the template's length before it.
    """
    slim = docs.select("doc_id", "text").withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64("text", "doc_id", F.lit(1))})
    words = license_words(F.col("text"))
    grams = F.transform(F.sequence(F.lit(0), F.size("words") - GRAM), lambda i: F.concat_ws(" ", F.get("words", i), F.get("words", i + 1)))
    rolled = slim.select("k1", "k2", words.alias("words")).filter(F.size("words") >= GRAM).select("k1", "k2", F.posexplode(grams).alias("pos", "gram"))
    known = F.broadcast(template_grams(docs.sparkSession, [(a, b, True) for a, b in phrases] + [(a, b, False) for a, b in templates]))
    hits = rolled.join(known, (F.xxhash64("gram") == known.t_hash) & (F.col("gram") == known.t_gram))
    votes = hits.groupBy("k1", "k2", "template", "label", "base", "t_words", (F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(
        F.collect_set("t_pos").alias("at")
    )
    voted = publish(votes, "license-votes")
    full = F.size("at") == F.col("t_words") - GRAM + 1
    run = Window.partitionBy("k1", "k2", "template").orderBy("diagonal")
    merged = (
        voted.filter("not base")
        .withColumn("new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(run) > GAP).cast("int"), F.lit(0)))
        .withColumn("island", F.sum("new").over(run))
        .groupBy("k1", "k2", "template", "label", "t_words", "island")
        .agg(F.flatten(F.collect_list(F.transform("at", lambda t: F.struct((F.col("diagonal") + t).cast("int").alias("pos"), (-t).alias("back"))))).alias("hits"))
        .withColumn("at", F.array_distinct(F.transform("hits", lambda h: -h["back"])))
        .filter(F.size(F.array_union("at", F.transform("at", lambda p: p + 1))) >= cover * F.col("t_words"))
        .withColumn("hits", F.transform(F.array_sort("hits"), lambda h: F.struct(h["pos"].alias("pos"), (-h["back"]).alias("t"))))
        .withColumn("cover", aligned_words(F.col("hits"), F.col("t_words") + GAP) / F.col("t_words"))
        .filter(F.col("cover") >= cover)
    )
    places = voted.filter(F.col("base") & full)
    found = places.select("k1", "k2", "label", "diagonal", F.lit(1.0).alias("cover")).unionByName(
        merged.select("k1", "k2", "label", F.lit(None).cast("int").alias("diagonal"), F.col("cover").cast("double"))
    )
    per_doc = found.groupBy("k1", "k2").agg(
        F.count("diagonal").alias("n_base"),
        F.min("diagonal").cast("long").alias("first_word"),
        F.max("diagonal").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("diagonal").isNotNull(), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("cover").alias("score"),
    )
    counted = slim.select("doc_id", "k1", "k2", F.size(words).cast("long").alias("n_words"))
    return counted.join(per_doc, ["k1", "k2"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
