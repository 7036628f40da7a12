"""License scans by diagonal voting, in DataFrame functions only.

Every rolling k-gram of words of every text is hashed and joined to the positions where templates have it: pairs of words for
the base phrases, triples for the notices. A hit at text word i and template word j votes for the diagonal i - j, on which a
verbatim copy puts all its votes. Diagonals of one template in one text that lie at most SHIFT apart are merged, since words
put in or left out move the rest of a copy to a neighbour. A span is verified by the words themselves, which are compared
besides their hashes, by the share of the template's words that its votes cover, and by its length in the text.

A base phrase is found where one diagonal covers it whole; a notice where a span covers COVERED of it, either one diagonal or
merged ones that lie within LONGER times its length. `labels` has both, `score` is the largest share that any span of
the text covers.

The templates are a fixed list, so the table of their k-grams is bounded and is broadcast; words that are no part of a hit
never leave their task. A text's hits meet by the text's row, the votes of a diagonal are at most a template's words.

Defined cases: null text is empty. A text without words has no places, null first and last word, empty labels and score 0.
Words are maximal runs of letters, digits and characters beyond 0x7F after A-Z are made small. Repeated rows and null
ids are rows of their own. Very long texts are read whole. An empty table gives an empty result. Extra columns are
ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The base phrases, and notices that stand for a license.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
NOTICES = (
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        "mit",
    ),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by 4 0", "cc-by"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
COVERED, SHIFT, LONGER = 0.8, 4, 1.5
PHRASE_GRAM, NOTICE_GRAM = 2, 3

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text. The Kelvin sign is the one character beyond 0x7F that lower() makes a letter from a to z; it becomes another that has no small form."""
    return F.regexp_extract_all(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ"))), F.lit(WORD), F.lit(0))


def gram(words: Column, at: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(words, at + x) for x in range(k)])


def template_grams(spark: SparkSession, kind: str, rows: tuple[tuple[str, str], ...], k: int) -> DataFrame:
    """hash and, for each template position that has it, (kind, template number, label, words of the template, position, the k words)."""
    listed = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(text).alias("text"), F.lit(label).alias("label")) for n, (text, label) in enumerate(rows)])
    each = spark.range(1).select(F.inline(listed)).select("n", "label", F.split("text", " ").alias("ws"))
    at = each.select("*", F.explode(F.sequence(F.lit(0), F.size("ws") - k)).alias("j"))
    place = F.struct(F.lit(kind).alias("kind"), "n", "label", F.size("ws").alias("size"), "j", F.slice("ws", F.col("j") + 1, k).alias("gram"))
    return at.groupBy(gram(F.col("ws"), F.col("j"), k).alias(f"h{k}")).agg(F.collect_list(place).alias(f"places{k}"))


def votes(docs: DataFrame, base: tuple = BASE, notices: tuple = NOTICES) -> DataFrame:
    """A row for each hit of a text, and one for a text without a hit at its first word: row, doc_id, n_words, i and the template's place, or null."""
    spark = docs.sparkSession
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), words_of(F.col("text")).alias("ws"))
    texts = texts.select("row", "doc_id", "ws", F.size("ws").cast("long").alias("n_words"))
    at = texts.select("*", F.explode_outer(F.when(F.col("n_words") > 0, F.sequence(F.lit(0), F.size("ws") - 1))).alias("i"))
    here = at.select("row", "doc_id", "n_words", "i", *[gram(F.col("ws"), F.col("i"), k).alias(f"h{k}") for k in (PHRASE_GRAM, NOTICE_GRAM)], *[F.get("ws", F.col("i") + x).alias(f"w{x}") for x in range(NOTICE_GRAM)])
    for kind, rows, k in (("phrase", base, PHRASE_GRAM), ("notice", notices, NOTICE_GRAM)):
        here = here.join(F.broadcast(template_grams(spark, kind, rows, k)), f"h{k}", "left")
    none = F.array().cast(here.schema[f"places{PHRASE_GRAM}"].dataType)
    verified = lambda k: F.filter(F.coalesce(f"places{k}", none), lambda p: p["gram"] == F.array(*[F.col(f"w{x}") for x in range(k)]))
    places = F.concat(verified(PHRASE_GRAM), verified(NOTICE_GRAM))
    found = here.where(F.col(f"places{PHRASE_GRAM}").isNotNull() | F.col(f"places{NOTICE_GRAM}").isNotNull() | F.coalesce(F.col("i") == 0, F.lit(True)))
    return found.select("row", "doc_id", "n_words", "i", F.explode_outer(places).alias("p"))


def spans(hits: DataFrame, shift: int = SHIFT, longer: float = LONGER) -> DataFrame:
    """row, doc_id, n_words, kind, label, at (the first word) and share of the template covered, of each place of a phrase and each span of a notice; kind is null
    for the row of a text without hits. hits is dealt by row, so nothing here moves again."""
    by = ["row", "doc_id", "n_words", "kind", "n", "label", "size"]
    lines = hits.select("row", "doc_id", "n_words", "i", "p.*").withColumn("d", F.col("i") - F.col("j"))
    lines = lines.groupBy(*by, "d").agg(F.collect_set("j").alias("js"), F.min("i").alias("first"), F.max("i").alias("last"))
    phrase = F.col("kind") == "phrase"
    width = F.when(phrase, PHRASE_GRAM).otherwise(NOTICE_GRAM)
    along = Window.partitionBy(*by).orderBy("d")
    apart = phrase | (F.col("d") - F.lag("d").over(along) > shift)
    lines = lines.withColumn("span", F.sum(F.coalesce(apart, F.lit(False)).cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    words = lambda js: F.size(F.array_distinct(F.flatten(F.transform(js, lambda j: F.sequence(j, j + width - 1)))))
    merged = lines.groupBy(*by, "span").agg(F.max(words(F.col("js"))).alias("one"), F.flatten(F.collect_list("js")).alias("js"), F.min("first").alias("at"), F.max("last").alias("last"))
    near = F.col("last") + width - F.col("at") <= F.col("size") * longer
    covered = F.when(near, words(F.col("js"))).otherwise(F.col("one"))
    return merged.select("row", "doc_id", "n_words", "kind", "label", "at", (covered / F.col("size")).alias("share"))


def license_scan(docs: DataFrame, base: tuple = BASE, notices: tuple = NOTICES, covered: float = COVERED) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    found = spans(votes(docs, base, notices).repartition("row"))
    place = (F.col("kind") == "phrase") & (F.col("share") == 1)
    listed = lambda which: F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")
    counted = (F.col("kind") == "notice") | place
    return found.groupBy("row", "doc_id", "n_words").agg(
        F.count_if(place).alias("n_base"),
        F.min(F.when(place, F.col("at"))).cast("long").alias("first_word"),
        F.max(F.when(place, F.col("at"))).cast("long").alias("last_word"),
        listed(place).alias("base_labels"),
        listed(place | ((F.col("kind") == "notice") & (F.col("share") >= covered))).alias("labels"),
        F.coalesce(F.max(F.when(counted, F.col("share"))), F.lit(0.0)).alias("score"),
    ).drop("row")


def op13_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _listed(rows: tuple[tuple[str, str], ...]) -> str:
    return ", ".join(f"({n}, '{text}', '{label}')" for n, (text, label) in enumerate(rows))


ORACLE = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
base AS (SELECT text, label, string_split(text, ' ') AS ws FROM (VALUES {_listed(BASE)}) t(n, text, label)),
notices AS (SELECT n, label, string_split(text, ' ') AS ws FROM (VALUES {_listed(NOTICES)}) t(n, text, label)),
words AS (SELECT row_id, ws, unnest(generate_series(0, len(ws) - 1)) AS i FROM docs WHERE len(ws) > 0),
places AS (SELECT row_id, i, label FROM words JOIN base ON words.ws[i + 1 : i + len(base.ws)] = base.ws),
grams AS (SELECT n, label, len(ws) AS size, j, ws[j + 1 : j + 3] AS g FROM (SELECT *, unnest(generate_series(0, len(ws) - 3)) AS j FROM notices)),
votes AS (SELECT row_id, n, label, size, i - j AS d, j, i FROM words JOIN grams ON words.ws[i + 1 : i + 3] = grams.g),
lines AS (SELECT row_id, n, label, size, d, list(DISTINCT j) AS js, min(i) AS a, max(i) AS b FROM votes GROUP BY ALL),
steps AS (SELECT *, coalesce(d - lag(d) OVER (PARTITION BY row_id, n ORDER BY d) > 4, false)::INT AS step FROM lines),
spans AS (SELECT *, sum(step) OVER (PARTITION BY row_id, n ORDER BY d) AS span FROM steps),
merged AS (
  SELECT row_id, label, size, max(len(list_distinct(flatten(list_transform(js, lambda x: [x, x + 1, x + 2]))))) AS one,
         len(list_distinct(flatten(list_transform(flatten(list(js)), lambda x: [x, x + 1, x + 2])))) AS every, max(b) + 3 - min(a) AS long
  FROM spans GROUP BY row_id, n, label, size, span),
shares AS (SELECT row_id, label, CAST(CASE WHEN long <= size * 1.5 THEN every ELSE one END AS DOUBLE) / size AS share FROM merged),
found AS (
  SELECT row_id, i, label, true AS base, 1.0::DOUBLE AS share, true AS holds FROM places
  UNION ALL SELECT row_id, NULL, label, false, share, share >= 0.8 FROM shares)
SELECT any_value(doc_id) AS doc_id, CAST(any_value(len(ws)) AS BIGINT) AS n_words, count(*) FILTER (base) AS n_base, CAST(min(i) AS BIGINT) AS first_word, CAST(max(i) AS BIGINT) AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (holds), '') AS labels, coalesce(max(share), 0.0::DOUBLE) AS score
FROM docs LEFT JOIN found USING (row_id) GROUP BY row_id
"""
