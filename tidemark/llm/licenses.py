"""License scan by diagonal voting: word k-grams of every document are joined with the places of license templates.

Each hit votes for the diagonal (place in the document minus place in the template). Votes are summed by diagonal;
neighbouring diagonals of a template (insertions and deletions shift them) are merged; a merged group is verified by
the share of the template's k-grams that it covers, and its words. The base phrases are short templates whose
diagonal must be complete. Only DataFrame functions run; the template table is fixed and small.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased.

Defined cases: null and empty text have no words, no places, empty labels and score 0; repeated rows give one row
each; overlapping places all count; ties between templates of one label give the label once; a very long text
costs in proportion to its words, and only its hits become rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import table

#: Base phrases and their labels (fixed values).
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices as their publishers recommend them, with the label of this scan (fixed values).
NOTICES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
     "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
     "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
     "the following conditions are met"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
     "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
     "any later version."),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PHRASE_K, NOTICE_K = 2, 4
#: Share of a notice's k-grams that a merged group covers at least.
COVERAGE = 0.7
#: Diagonals at most this far apart are neighbours.
NEIGHBOURS = 4


def template_words(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def templates() -> list[tuple[int, str, bool, int, list[str]]]:
    """(id, label, base, k, words)"""
    rows = [(label, True, PHRASE_K, template_words(p)) for p, label in PHRASES.items()]
    rows += [(label, False, NOTICE_K, template_words(t)) for label, t in NOTICES]
    return [(i, *r) for i, r in enumerate(rows)]


def _gram(k: int, words: list[Column]) -> Column:
    return F.xxhash64(F.lit(k), *[F.xxhash64(w) for w in words])


def _template_places(spark: SparkSession) -> DataFrame:
    """(tid, label, base, need, tpos, gram, tw): one row for each k-gram of each template; a few hundred rows."""
    rows = [(i, label, base, len(w) - k + 1, p, k, w[p : p + k])
            for i, label, base, k, w in templates() for p in range(len(w) - k + 1)]
    df = spark.createDataFrame(rows, "tid int, label string, base boolean, need int, tpos int, k int, tw array<string>")
    gram = F.when(F.col("k") == PHRASE_K, _gram(PHRASE_K, [F.col("tw")[i] for i in range(PHRASE_K)])).otherwise(
        _gram(NOTICE_K, [F.get("tw", F.lit(i)) for i in range(NOTICE_K)]))
    return df.withColumn("gram", gram)


def spans(docs: DataFrame) -> DataFrame:
    """(key, doc_id, n_words, copies, places): places of verified templates in every document.

    places: array of (label, base, start, end, coverage); copies: number of equal rows.
    """
    places = _template_places(docs.sparkSession)
    tokens = docs.select(
        F.xxhash64("doc_id", "text").alias("key"), "doc_id",
        F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), F.lit(f"({WORD})"), F.lit(1)).alias("words"))
    hashed = tokens.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    # the grams of the templates, a few hundred constants
    sought = {k: [r["gram"] for r in places.where(F.col("k") == k).select("gram").distinct().collect()] for k in (PHRASE_K, NOTICE_K)}

    def hits(k: int) -> Column:
        """(pos, gram, k, here): the k-grams of a document that a template has, with their own words only."""
        grams = F.transform("h", lambda x, i: F.struct(
            i.alias("pos"), F.xxhash64(F.lit(k), x, *[F.get("h", i + j) for j in range(1, k)]).alias("gram")))
        found = F.filter(grams, lambda g: g["gram"].isin(sought[k]))
        return F.transform(found, lambda g: F.struct(
            g["pos"].alias("pos"), g["gram"].alias("gram"), F.lit(k).alias("k"), F.slice("words", g["pos"] + 1, F.lit(k)).alias("here")))

    nothing = F.array(F.struct(F.lit(0).alias("pos"), F.lit(None).cast("long").alias("gram"), F.lit(None).cast("int").alias("k"),
                               F.lit(None).cast("array<string>").alias("here")))
    # phrases, notices, and one empty place that keeps documents without hits
    placed = hashed.select("key", "doc_id", F.size("words").alias("n"), F.inline(F.concat(hits(PHRASE_K), hits(NOTICE_K), nothing)))
    voted = placed.join(F.broadcast(places), ["gram", "k"], "left").where("gram is null or tid is not null")
    verified = voted.where("tid is null or here = tw").repartition("key")
    diagonals = verified.groupBy("key", "doc_id", "n", "tid", "label", "base", "need", "k", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(
        F.collect_set("tpos").alias("covered"), F.min("pos").alias("start"), F.max("pos").alias("last"), F.count("*").alias("votes"))
    order = Window.partitionBy("key", "doc_id", "n", "tid").orderBy("diagonal")
    gap = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order), F.lit(0))
    opens = (gap > F.when(F.col("base"), F.lit(0)).otherwise(F.lit(NEIGHBOURS))).cast("int")
    groups = diagonals.withColumn("opens", opens).withColumn("group", F.sum("opens").over(order)).groupBy(
        "key", "doc_id", "n", "tid", "label", "base", "need", "k", "group").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).alias("covered"),
        F.min("start").alias("start"), F.max("last").alias("last"), F.max("votes").alias("votes"))
    coverage = F.col("covered") / F.col("need")
    good = F.when(F.col("base"), F.col("covered") == F.col("need")).otherwise(coverage >= COVERAGE)
    place = F.struct("label", "base", "start", (F.col("last") + F.col("k")).alias("end"), coverage.alias("coverage"))
    return groups.groupBy("key", "doc_id", "n").agg(
        F.max(F.when(F.col("tid").isNull(), F.col("votes"))).alias("copies"),
        F.collect_list(F.when(good, place)).alias("places")).withColumnRenamed("n", "n_words")


def query(spark: SparkSession, folder: str) -> DataFrame:
    """op1: one row for each document."""
    found = spans(table(spark, folder, "documents"))
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["start"])
    label = F.transform("places", lambda p: p["label"])
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(base, lambda p: p["label"]))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(label)), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["coverage"])), F.lit(0.0)).alias("score"))


def _values() -> str:
    quoted = ", ".join(
        f"({i}, '{label}', {str(base).lower()}, {k}, [{', '.join(repr(w) for w in words)}])" for i, label, base, k, words in templates())
    return f"(VALUES {quoted}) AS t(tid, label, base, k, tw)"


SQL = rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS ws FROM documents),
t AS (
  SELECT tid, label, base, k, len(tw) - k + 1 AS need, p - 1 AS tpos, array_to_string(tw[p : p + k - 1], ' ') AS gram
  FROM {_values()}, unnest(generate_series(1, len(tw) - k + 1)) AS u(p)),
g AS (
  SELECT doc_id, ks.k, p - 1 AS pos, array_to_string(ws[p : p + ks.k - 1], ' ') AS gram
  FROM w, (VALUES ({PHRASE_K}), ({NOTICE_K})) AS ks(k), unnest(generate_series(1, len(ws) - ks.k + 1)) AS u(p)),
d AS (
  SELECT doc_id, tid, label, base, need, pos - tpos AS diagonal, min(pos) AS start, list(tpos) AS covered
  FROM g JOIN t USING (k, gram) GROUP BY ALL),
o AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER v > CASE WHEN base THEN 0 ELSE {NEIGHBOURS} END THEN 1 ELSE 0 END AS opens
  FROM d WINDOW v AS (PARTITION BY doc_id, tid ORDER BY diagonal)),
i AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, tid ORDER BY diagonal) AS grp FROM o),
m AS (
  SELECT doc_id, tid, label, base, need, grp, min(start) AS start, len(list_distinct(flatten(list(covered)))) AS covered
  FROM i GROUP BY ALL),
f AS (SELECT *, CAST(covered AS DOUBLE) / need AS coverage FROM m
      WHERE CASE WHEN base THEN covered = need ELSE CAST(covered AS DOUBLE) / need >= {COVERAGE} END),
s AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(coverage) AS score
  FROM f GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word,
       CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(score, 0.0) AS score
FROM w LEFT JOIN s USING (doc_id)
"""
