"""License scans by diagonal voting.

All rolling word k-gram hashes of a text are joined to the positions they have in the
license templates. A match of position p in the text and t in a template votes for the
diagonal p - t. A diagonal with every k-gram of its template is a place where the
template stands word for word; diagonals that lie side by side (a word added or left
out shifts the rest) are merged, and the merged span's share of the template's k-grams
is verified against a threshold.

k-grams that no template has are dropped before the join, by a bit table over the
templates' hashes; those left carry their words, which the join verifies.

Defined results: a null or empty text has no words and no labels; a template of fewer
than k words is not allowed; repeated documents each get their row. Columns other than
the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from tessella.llm._words import ALNUM, as_bytes, chunks, rolling, scan, window_starts
from tessella.session import lean, materialise, ship

GRAM = 3
#: Share of a template's k-grams that a merged span needs.
COVERED = 0.7
#: Diagonals at most this far apart are neighbours.
NEAR = 3

#: The phrases whose every place counts, and the label of each.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Opening words of public license notices, and the label of each.
NOTICES = {
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files": "mit",
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License": "apache-2",
    "licensed under the GNU General Public License, version 3": "gpl-3",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License": "gpl",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met": "bsd",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0": "mpl-2",
    "This work is licensed under a Creative Commons Attribution-NonCommercial": "cc-by-nc",
    "This is free and unencumbered software released into the public domain": "unlicense",
    "All rights reserved. No part of this publication may be reproduced": "proprietary",
}


def template_grams(templates: list[tuple[str, str, bool]], k: int = GRAM) -> list[tuple]:
    """(template number, label, exact, k-grams in template, position, hash, words) of (text, label, exact)."""
    out = []
    for number, (text, label, exact) in enumerate(templates):
        chunk = scan([text.encode()], ALNUM)
        hashes = rolling(chunk.hashes, k).view(np.int64).tolist()
        if not hashes:
            raise ValueError(f"template of fewer than {k} words: {text}")
        out += [(number, label, exact, len(hashes), i, h, chunk.phrase(i, k).decode()) for i, h in enumerate(hashes)]
    return out


def default_templates() -> list[tuple[str, str, bool]]:
    return [(t, label, True) for t, label in PHRASES.items()] + [(t, label, False) for t, label in NOTICES.items()]


def _grams(known: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << 16, bool)
        table[(known.view(np.uint64) >> np.uint64(48)).astype(np.int64)] = True
        kind = pa.list_(pa.struct([("pos", pa.int64()), ("hash", pa.int64()), ("words", pa.string())]))
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            n_words, found = [], []
            for a, b in chunks(texts):
                chunk = scan(texts[a:b], ALNUM)
                n_words += np.diff(chunk.first).tolist()
                per_text: list[list] = [[] for _ in range(b - a)]
                hashes = rolling(chunk.hashes, k)
                at = np.flatnonzero(table[(hashes >> np.uint64(48)).astype(np.int64)] & window_starts(chunk.first, k, len(chunk.starts))) if len(hashes) else hashes
                owners = np.searchsorted(chunk.first, at, side="right") - 1
                for i, owner, h in zip(at.tolist(), owners.tolist(), hashes[at.astype(np.int64)].view(np.int64).tolist()):
                    per_text[owner].append({"pos": i - int(chunk.first[owner]), "hash": h, "words": chunk.phrase(i, k).decode(errors="replace")})
                found += per_text
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n_words, pa.int64()), pa.array(found, kind)], names=["id", "n_words", "grams"])

    return run


def _template_table(spark: SparkSession, templates, k: int) -> tuple[DataFrame, np.ndarray]:
    rows = template_grams(templates, k)
    frame = spark.createDataFrame(rows, "template int, label string, exact boolean, grams_in int, t_pos long, hash long, words string")
    return frame, np.array([r[5] for r in rows], np.int64)


def scan_licenses(
    docs: DataFrame, templates: list[tuple[str, str, bool]] | None = None, *, id_col: str = "doc_id", text_col: str = "text", k: int = GRAM, covered: float = COVERED, near: int = NEAR,
) -> DataFrame:
    """Per document: id, n_words, exact (first word and label of each place of an exact template), spans (label, first word, last word, share)."""
    spark = docs.sparkSession
    ship(spark)
    known, hashes = _template_table(spark, templates or default_templates(), k)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    grams = source.mapInArrow(lean(_grams(hashes, k)), T.StructType([
        source.schema["id"], T.StructField("n_words", T.LongType()),
        T.StructField("grams", T.ArrayType(T.StructType([T.StructField("pos", T.LongType()), T.StructField("hash", T.LongType()), T.StructField("words", T.StringType())]))),
    ]))
    rows = materialise(grams.withColumn("row", F.monotonically_increasing_id()), "license-grams")
    # The templates are a fixed list, so their table may be broadcast.
    votes = rows.select("row", F.explode("grams").alias("g")).select("row", "g.*").join(F.broadcast(known), ["hash", "words"])
    diagonals = votes.withColumn("diagonal", F.col("pos") - F.col("t_pos")).groupBy("row", "template", "label", "exact", "grams_in", "diagonal").agg(
        F.count("*").alias("votes"), F.collect_set("t_pos").alias("hit"), F.min("pos").alias("first"), (F.max("pos") + k - 1).alias("last"))
    along = W.partitionBy("row", "template").orderBy("diagonal")
    apart = diagonals.where("NOT exact").withColumn("new", F.when(F.col("diagonal") - F.lag("diagonal").over(along) <= near, 0).otherwise(1))
    merged = apart.withColumn("span", F.sum("new").over(along)).groupBy("row", "template", "label", "grams_in", "span").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("hit")))).alias("hits"), F.min("first").alias("first"), F.max("last").alias("last"))
    merged = merged.withColumn("share", F.col("hits") / F.greatest("grams_in", F.col("last") - F.col("first") + 2 - k))
    spans = merged.where(F.col("share") >= covered).groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("first", "last", "label", "share"))).alias("spans"))
    exact = diagonals.where("exact AND votes = grams_in").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("diagonal", "label"))).alias("exact"))
    best = merged.groupBy("row").agg(F.max("share").alias("best"))
    return rows.select("id", "n_words", "row").join(exact, "row", "left").join(spans, "row", "left").join(best, "row", "left").select(
        "id", "n_words", F.coalesce("exact", F.expr("cast(array() as array<struct<diagonal: bigint, label: string>>)")).alias("exact"),
        F.coalesce("spans", F.expr("cast(array() as array<struct<first: bigint, last: bigint, label: string, share: double>>)")).alias("spans"),
        F.coalesce("best", F.lit(0.0)).alias("best"))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    found = scan_licenses(docs)
    base = F.array_distinct(F.transform("exact", lambda e: e["label"]))
    more = F.transform("spans", lambda s: s["label"])
    return found.select(
        F.col("id").alias("doc_id"), "n_words", F.size("exact").cast("long").alias("n_base"),
        F.array_min("exact")["diagonal"].alias("first_word"), F.array_max("exact")["diagonal"].alias("last_word"),
        F.array_join(F.sort_array(base), ",").alias("base_labels"), F.array_join(F.sort_array(F.array_distinct(F.concat(base, more))), ",").alias("labels"),
        F.when(F.size("exact") > 0, 1.0).otherwise(F.least("best", F.lit(1.0))).alias("score"),
    )
