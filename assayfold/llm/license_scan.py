"""License scans by diagonal voting.

A text's rolling word k-gram hashes are joined to the positions of the templates' k-grams. A hit votes for the diagonal
text position minus template position: a verbatim span puts all its votes on one diagonal, a span with words put in or
left out on neighbouring ones. Neighbouring diagonals of a template are merged into spans of bounded width. A hit whose words are not the
template's is no hit, so a span is verified word by word; it counts where enough different template positions are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Words of a k-gram; how far a diagonal may lie from the next of its span; share of a template's k-grams that a span needs.
#: K-grams under which a template must stand there whole; k-grams that are named to the projection at most.
K, DRIFT, COVERAGE, SHORT, KEYS = 3, 6, 0.6, 12, 10_000
#: A word: digits, a-z after lowering, and all code points above 0x7F.
NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


SPAN = "struct<template: int, label: string, exact: boolean, start: bigint, votes: bigint, share: double>"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    exact: bool = False


#: Phrases whose every place counts.
PHRASES = (
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
)
#: Short public notices and opening sentences of common licenses.
TEMPLATES = (
    Template(
        "mit",
        (
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
            "Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
            "distribute, sublicense, and/or sell copies of the Software"
        ),
    ),
    Template(
        "apache-2",
        (
            "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
            "http://www.apache.org/licenses/LICENSE-2.0"
        ),
    ),
    Template(
        "bsd",
        (
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
            "are met"
        ),
    ),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    Template(
        "gpl",
        (
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
            "by the Free Software Foundation"
        ),
    ),
    Template("gpl", "licensed under the GNU General Public License"),
    Template("lgpl", "licensed under the GNU Lesser General Public License"),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("cc-by", "licensed under a Creative Commons Attribution"),
    Template("agpl", "GNU Affero General Public License as published by the Free Software Foundation"),
    Template("apache-2", "Licensed under the Apache License, Version 2.0 (the License)"),
    Template("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    Template(
        "bsd",
        (
            "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
            "documentation and/or other materials provided with the distribution"
        ),
    ),
    Template(
        "zlib",
        (
            "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages "
            "arising from the use of this software"
        ),
    ),
    Template("cc0", "has waived all copyright and related or neighboring rights"),
    Template("cc-by-sa", "licensed under a Creative Commons Attribution ShareAlike"),
    Template("cc-by-nc", "licensed under a Creative Commons Attribution NonCommercial"),
    Template("epl-2", "made available under the terms of the Eclipse Public License 2.0"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
)


def words(text: Column) -> Column:
    """Words of a text with A-Z lowered; none for null."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lowered, NOT_WORD), lambda w: w != "")


def grams(of: Column | str, k: int) -> Column:
    """Hashes of all rolling k-grams, by position from 0; none if there are fewer words."""
    of = F.col(of) if isinstance(of, str) else of
    return F.when(F.size(of) >= k, F.transform(F.sequence(F.lit(1), F.size(of) - k + 1), lambda i: F.xxhash64(F.slice(of, i, k)))).otherwise(
        F.expr("cast(array() as array<bigint>)")
    )


def index(spark: SparkSession, templates: tuple[Template, ...], k: int) -> DataFrame:
    """(template, label, exact, n_grams, at, gram, words): every k-gram position of the templates, as large as these."""
    rows = [(i, t.label, t.exact, t.text) for i, t in enumerate(templates)]
    frame = spark.createDataFrame(rows, "template int, label string, exact boolean, text string").withColumn("all", words(F.col("text"))).withColumn(
        "grams", grams("all", k)
    )
    frame = frame.select("template", "label", "exact", F.size("grams").alias("n_grams"), "all", F.posexplode("grams").alias("at", "gram"))
    return frame.withColumn("words", F.slice("all", F.col("at") + 1, k)).drop("all")


def scan(
    docs: DataFrame, templates: tuple[Template, ...] = PHRASES + TEMPLATES, k: int = K, drift: int = DRIFT, coverage: float = COVERAGE
) -> DataFrame:
    """One row per row of docs: doc_id, n_words, and `spans`, an array of (template, label, exact, start, votes, share).

    start is where the template's first word stands, or would by the smallest of the span's diagonals. A template marked
    exact needs all its k-grams on one diagonal; of another, the span's different template positions must make up
    `coverage` of its k-grams, and all of them if it has fewer than SHORT. A span's diagonals lie within `width` of its
    first, so that hits scattered over a long text do not add up. Templates shorter than k words are refused. Null texts
    have no words and no spans; every row is scanned for itself, rows with equal or null doc_id too; an empty table
    gives none. Other columns are ignored.
    """
    spark = docs.sparkSession
    keys = index(spark, templates, k)
    short = {
        r.template
        for r in spark.range(len(templates)).select(F.col("id").cast("int").alias("template")).join(keys, "template", "left_anti").collect()
    }
    if short:
        raise ValueError(f"templates shorter than {k} words: {sorted(short)}")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words(F.col("text")).alias("words"))
    rows = rows.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), "words", grams("words", k).alias("grams"))
    known = [r.gram for r in keys.select("gram").distinct().limit(KEYS + 1).collect()]  # the templates', not the documents'
    few = len(known) <= KEYS
    # with few templates only their k-grams leave the projection; either way the join decides
    hit = lambda g, i: F.when(
        g.isin(known) if few else F.lit(True), F.struct(g.alias("gram"), i.alias("pos"), F.slice("words", i + 1, k).alias("found"))
    )
    at = F.filter(F.transform("grams", hit), lambda x: x.isNotNull())
    # each row keeps one entry without a gram, so that rows without hits come through
    none = F.array(F.expr("named_struct('gram', cast(null as bigint), 'pos', -1, 'found', cast(null as array<string>))"))
    hits = rows.select("row", "doc_id", "n_words", F.explode(F.concat(none, at)).alias("hit")).select("row", "doc_id", "n_words", "hit.*")
    # equal hashes propose, equal words decide
    hits = hits.join(F.broadcast(keys) if few else keys, "gram", "left").where("gram is null or found = words")
    hits = hits.select(
        "row", "doc_id", "n_words", "template", "label", "exact", "n_grams", "at", (F.col("pos") - F.col("at")).cast("long").alias("diagonal")
    )
    hits = hits.repartition("row")  # all that follows is by row, and needs no other exchange
    by = ["row", "doc_id", "n_words"]
    kind = ["template", "label", "exact", "n_grams"]
    # neighbouring diagonals are one span: a new one opens where the last diagonal is too far, or with each exact one
    order = W.partitionBy(*by, *kind).orderBy("diagonal")
    step = F.col("diagonal") - F.lag("diagonal").over(order)
    chains = hits.withColumn("_opens", F.coalesce(F.when(F.col("exact"), step > 0).otherwise(step > drift), F.lit(True)).cast("int"))
    chains = chains.withColumn("chain", F.sum("_opens").over(order.rowsBetween(W.unboundedPreceding, 0)))
    first = F.min("diagonal").over(W.partitionBy(*by, *kind, "chain"))
    spans = chains.withColumn("part", F.floor((F.col("diagonal") - first) / width(F.col("n_grams"), drift)))
    spans = spans.groupBy(*by, *kind, "chain", "part").agg(F.min("diagonal").alias("start"), F.countDistinct("at").alias("votes"))
    least = F.when(F.col("exact") | (F.col("n_grams") < SHORT), F.col("n_grams")).otherwise(coverage * F.col("n_grams"))
    share = F.when(F.col("exact"), 1.0).otherwise(F.col("votes") / F.col("n_grams")).alias("share")
    one = F.when(
        F.col("template").isNotNull() & (F.col("votes") >= least), F.struct("template", "label", "exact", "start", "votes", share).cast(SPAN)
    )
    return spans.groupBy(*by).agg(F.array_sort(F.collect_list(one)).alias("spans")).select("doc_id", "n_words", "spans")


def width(n_grams: Column, drift: int) -> Column:
    """How far a span's diagonals may lie from its first: half the template, four drifts at least."""
    return F.greatest(F.floor(n_grams / 2), F.lit(4 * drift))
