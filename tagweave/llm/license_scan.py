"""License scan by diagonal voting, with DataFrame functions alone.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z in lower case. Every rolling gram of three words is joined
to the places of the same gram in license templates (a fixed list, so its broadcast is bounded); a license text has several, one for
each of its sentences that tell it, under one label. A hit votes for
the diagonal place - template place; a diagonal keeps the bits of the template's grams that it saw, and is verified
where it alone sees LEAST of them. Diagonals of a document and template that are at most GAP apart are merged, which bridges
a few words put in or left out, and the merged span is verified: it must see LEAST of the template's grams in at most SPREAD
times the template's length.

Defined cases: a null or empty text has no words, no labels, null places and score 0; equal rows get a row each; a table
without rows gives none; texts of any length are scanned whole; where a text names one license many times each place counts in
n_base; places are numbers of words, so no two tie; of several spans of a template the best counts, and score is the greatest share of a template's grams that one merged span
sees. Only doc_id and text are read, whatever other columns are called.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import read, ship

GRAM, GAP, LEAST, SPREAD = 3, 3, 0.75, 1.5
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases of the base labels.
BASE = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}

#: Sentences of license texts and notices, at most 64 grams each; those of one label stand together.
TEMPLATES = (
    ("mit-notice", "Released under the MIT License"),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit-text", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit-text", "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement"),
    ("mit-text", "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software"),
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0-text", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0-text", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an as is basis, without warranties or conditions of any kind, either express or implied"),
    ("apache-2.0-text", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work"),
    ("apache-2.0-text", "You must cause any modified files to carry prominent notices stating that You changed the files"),
    ("gpl-2.0-notice", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl-3.0-notice", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-text", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl-text", "This program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. See the GNU General Public License for more details"),
    ("gpl-text", "You should have received a copy of the GNU General Public License along with this program"),
    ("gpl-text", "The GNU General Public License is a free, copyleft license for software and other kinds of works"),
    ("gpl-text", "You may convey verbatim copies of the Program's source code as you receive it, in any medium, provided that you conspicuously and appropriately publish on each copy an appropriate copyright notice"),
    ("lgpl-text", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("agpl-notice", "under the terms of the GNU Affero General Public License"),
    ("bsd-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-text", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd-text", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("isc-text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0-text", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense-text", "This is free and unencumbered software released into the public domain"),
    ("cc-by-4.0-notice", "Licensed under CC BY 4.0"),
    ("cc-by-sa-4.0-notice", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc-4.0-notice", "Licensed under CC BY-NC 4.0"),
    ("cc-by-text", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("all-rights-reserved", "All rights reserved"),
)


def template_words(text: str) -> list[str]:
    return re.findall(r"[0-9a-z]+", text.lower())


def _templates(spark) -> DataFrame:
    """One row per gram of any template: its words, and its places as (template, place) pairs."""
    rows = []
    for t, (_, text) in enumerate(TEMPLATES):
        w = template_words(text)
        rows += [f"('{w[p]}', '{w[p + 1]}', '{w[p + 2]}', {t}, {p})" for p in range(len(w) - GRAM + 1)]
    grams = spark.sql("select * from values " + ", ".join(rows) + " as t(t0, t1, t2, template, place)")
    return grams.groupBy("t0", "t1", "t2").agg(F.collect_list(F.struct("template", "place")).alias("places")).withColumn("gram", F.xxhash64("t0", "t1", "t2"))


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: base places and labels, and the labels of verified template spans."""
    names = sorted({*BASE, *(n for n, _ in TEMPLATES)})
    bit = {n: 1 << i for i, n in enumerate(names)}
    words = F.regexp_extract_all(F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(WORD), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words.alias("w")).select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("w").cast("long").alias("n_words"), "w")
    three = F.arrays_zip(F.col("w").alias("w0"), F.expr("slice(w, 2, greatest(size(w) - 1, 0))").alias("w1"), F.expr("slice(w, 3, greatest(size(w) - 2, 0))").alias("w2"))
    each = rows.select("row", "doc_id", "n_words", F.posexplode_outer(three).alias("at", "g")).select("row", "doc_id", "n_words", "at", "g.w0", "g.w1", "g.w2")

    base = (
        F.when((F.col("w0") == "mit") & (F.col("w1") == "license"), F.lit(bit["mit"]))
        .when((F.col("w0") == "apache") & (F.col("w1") == "license"), F.lit(bit["apache"]))
        .when((F.col("w0") == "general") & (F.col("w1") == "public") & (F.col("w2") == "license"), F.lit(bit["gpl"]))
        .otherwise(F.lit(0))
        .cast("long")
    )
    each = each.withColumn("base", base).withColumn("gram", F.xxhash64("w0", "w1", "w2"))
    grams = F.broadcast(_templates(docs.sparkSession).select(F.col("gram").alias("t_gram"), "t0", "t1", "t2", "places"))
    joined = each.join(grams, (F.col("gram") == F.col("t_gram")) & (F.col("w0") == F.col("t0")) & (F.col("w1") == F.col("t1")) & (F.col("w2") == F.col("t2")), "left")
    # kept: every document's first row, base places and hits
    kept = joined.where((F.coalesce(F.col("at"), F.lit(0)) == 0) | (F.col("base") > 0) | F.col("places").isNotNull())
    own = F.array(F.struct(F.lit(-1).alias("template"), F.lit(0).alias("place")))
    votes = kept.select("row", "doc_id", "n_words", "at", "base", F.explode(F.concat(own, F.coalesce("places", F.expr("cast(array() as array<struct<template:int,place:int>>)")))).alias("v"))
    is_own = F.col("v.template") == -1
    on_base = is_own & (F.col("base") > 0)
    diagonals = votes.groupBy("row", "doc_id", "n_words", F.col("v.template").alias("template"), F.when(is_own, F.lit(0)).otherwise(F.col("at") - F.col("v.place")).alias("diagonal")).agg(
        F.bit_or(F.when(~is_own, F.expr("shiftleft(1L, v.place)")).otherwise(F.lit(0).cast("long"))).alias("seen"),
        F.min("at").alias("lo"),
        F.max("at").alias("hi"),
        F.count_if(on_base).alias("n_base"),
        F.min(F.when(on_base, F.col("at"))).alias("first_word"),
        F.max(F.when(on_base, F.col("at"))).alias("last_word"),
        F.bit_or(F.when(is_own, F.col("base")).otherwise(F.lit(0).cast("long"))).alias("base_bits"),
    )
    sizes = [len(template_words(t)) for _, t in TEMPLATES]
    size = F.get(F.array(*map(F.lit, sizes)), F.col("template"))
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    new = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(along) > GAP).cast("int"), F.lit(0))
    merged = (
        diagonals.withColumn("new", new)
        .withColumn("span", F.sum("new").over(along))
        .groupBy("row", "doc_id", "n_words", "template", "span")
        .agg(*(F.bit_or(c).alias(c) for c in ("seen", "base_bits")), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max(F.bit_count("seen")).alias("alone"), F.sum("n_base").alias("n_base"), F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"))
    )
    label = F.get(F.array(*(F.lit(bit[n]).cast("long") for n, _ in TEMPLATES)), F.col("template"))
    share = F.when(F.col("template") >= 0, F.bit_count("seen") / (size - (GRAM - 1))).otherwise(F.lit(0.0))
    together = (share >= LEAST) & (F.col("hi") - F.col("lo") + GRAM <= SPREAD * size)
    verified = (F.col("template") >= 0) & (together | (F.col("alone") / (size - (GRAM - 1)) >= LEAST))
    out = merged.withColumn("share", share).withColumn("bits", F.when(verified, label).otherwise(F.lit(0).cast("long"))).groupBy("row", "doc_id", "n_words").agg(
        F.sum("n_base").alias("n_base"),
        F.min("first_word").cast("long").alias("first_word"),
        F.max("last_word").cast("long").alias("last_word"),
        F.bit_or("base_bits").alias("base_bits"),
        F.bit_or("bits").alias("bits"),
        F.max("share").alias("score"),
    )

    def told(bits):
        return F.array_join(F.array_compact(F.array(*(F.when(bits.bitwiseAND(F.lit(b).cast("long")) != 0, F.lit(n)) for n, b in bit.items()))), ",")

    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", told(F.col("base_bits")).alias("base_labels"), told(F.col("base_bits").bitwiseOR(F.col("bits"))).alias("labels"), "score")


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    ship(spark)
    return scan(read(spark, sf_dir, "documents"))


def _values(rows: list[tuple]) -> str:
    return "(values " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows) + ")"


def oracle() -> str:
    """DuckDB SQL for the rows of op3_license_scan: the same voting, merging and verification from a table of all words."""
    words = [template_words(t) for _, t in TEMPLATES]
    grams = [(*w[p : p + GRAM], t, p) for t, w in enumerate(words) for p in range(len(w) - GRAM + 1)]
    sizes = [(t, name, len(w)) for t, ((name, _), w) in enumerate(zip(TEMPLATES, words, strict=True))]
    base = " ".join(f"when {' and '.join(f'w{i} = {chr(39)}{w}{chr(39)}' for i, w in enumerate(phrase.split()))} then '{label}'" for label, phrase in BASE.items())
    return rf"""with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') as w from documents),
    e as (select r, unnest(range(len(w))) as pos, unnest(w) as w0, unnest(w[2:]) as w1, unnest(w[3:]) as w2 from d),
    b as (select r, pos, case {base} end as label from e), based as (select r, count(*) as n_base, min(pos) as first_word, max(pos) as last_word from b where label is not null group by 1),
    grams(t0, t1, t2, t, p) as {_values(grams)}, sizes(t, name, size) as {_values(sizes)},
    diag as (select r, t, pos - p as diagonal, bit_or(1::bigint << p) as seen, min(pos) as lo, max(pos) as hi from e join grams on w0 = t0 and w1 = t1 and w2 = t2 group by all),
    cut as (select *, coalesce(diagonal - lag(diagonal) over (partition by r, t order by diagonal) > {GAP}, false)::integer as new from diag),
    spans as (select *, sum(new) over (partition by r, t order by diagonal) as span from cut),
    merged as (select r, name, size, bit_count(bit_or(seen)) / (size - {GRAM - 1}) as share, max(bit_count(seen)) / (size - {GRAM - 1}) as alone, max(hi) - min(lo) + {GRAM} as width from spans join sizes using (t) group by r, t, name, size, span),
    told as (select distinct r, label, true as base from b where label is not null union all select distinct r, name, false from merged where alone >= {LEAST} or share >= {LEAST} and width <= {SPREAD} * size),
    labels as (select r, string_agg(distinct label, ',' order by label) filter (where base) as base_labels, string_agg(distinct label, ',' order by label) as labels from told group by 1),
    scores as (select r, max(share) as score from merged group by 1)
    select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0)::double as score
    from d left join based using (r) left join labels using (r) left join scores using (r)"""
