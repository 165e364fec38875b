"""Licence scan by a positional index of the templates' words; DataFrame functions only.

Words are runs of digits, letters and anything beyond ASCII, A-Z lower-cased. Base phrases are counted word by word. The method: the IDF of the
templates' words over all documents; each file looks up every licence word it holds but those of COMMON; postings of (template, place) turn a word's place into
the place where the template would start; places on which enough weight agrees are candidates, and count if all words of the template's key phrase
stand there. What else a file holds takes nothing from a template's share.

Cases: a null or empty text has no words; rows with equal or null doc_id are told apart and each scanned; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save

#: Base phrases and their labels (fixed values).
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Label: (words of the template, key phrase that must stand in it). `_` in a key stands for any word.
TEMPLATES = {
    "apache-2.0": ("licensed under the apache license version 2 0", "apache license"),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    "cc-by-nc-4.0": ("licensed under cc by nc 4 0", "cc by nc"),
    "cc-by-sa-4.0": ("licensed under cc by sa 4 0", "cc by sa"),
    "gpl-3.0": ("licensed under the gnu general public license version 3", "gnu general public license version 3"),
    "lgpl": ("licensed under the gnu lesser general public license", "gnu lesser general public license"),
    "mit": ("released under the mit license", "mit license"),
    "mit-grant": ("permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted free of charge"),
    "mpl-2.0": ("subject to the terms of the mozilla public license version 2 0", "mozilla public license"),
}
#: Words too common to be looked up.
COMMON = frozenset("a and any are by charge copy free in is nc of or person sa source terms the to use with without 0 2 3 4".split())
#: What stands between words, once A-Z are lower-cased.
OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Each base phrase and each key phrase holds one of these; the words of texts without any are counted, then left.
ANCHORS = ["cc", "license", "permission", "redistribution", "reserved"]


def _words(phrase: str) -> list[str]:
    return phrase.split()


def _stands(words: Column, at: Column, phrase: str) -> Column:
    out = F.lit(True)
    for k, w in enumerate(_words(phrase)):
        out = out & F.coalesce(F.get(words, at + k) == w, F.lit(False))
    return out


def _places(at: Column, phrase: str) -> Column:
    return F.filter(at, lambda i: _stands(F.col("words"), i, phrase))


def scan(docs: DataFrame, least: float = 0.6) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the best template's share of IDF found; at least 0.5 with a base phrase)."""
    spark = docs.sparkSession
    # lower() goes beyond A-Z, but makes no sign a word's part or end, and no other sign but the Kelvin sign (k, which no phrase holds) into a plain letter of ASCII
    words = F.array_remove(F.split(F.lower(F.coalesce("text", F.lit(""))), OTHER), "")
    vocabulary = sorted({w for t, _ in TEMPLATES.values() for w in _words(t)} - COMMON)
    read = docs.select("doc_id", words.alias("words"))
    known = read.select("doc_id", "words", F.array_intersect("words", F.lit(sorted({*vocabulary, *ANCHORS}))).alias("known"))
    holds = F.array_intersect("known", F.lit(vocabulary))
    anchored = F.arrays_overlap("known", F.lit(ANCHORS))
    rows = save(known.select("doc_id", F.monotonically_increasing_id().alias("row"), F.size("words").cast("long").alias("n_words"), holds.alias("holds"), F.when(anchored, F.col("words")).alias("words")))

    total = rows.count()
    df = rows.select(F.explode("holds").alias("word")).groupBy("word").count()
    idf = {r.word: r["count"] for r in df.collect()}  # at most the words of the templates
    weight = spark.createDataFrame([(w, k, t, _log_ratio(total, idf.get(w, 0))) for t, (text, _) in TEMPLATES.items() for k, w in enumerate(_words(text)) if w not in COMMON], "word string, place int, template string, idf double")
    key_words = [(t, text.split().index(_words(key)[0]) + k, w, len([x for x in _words(key) if x != "_"])) for t, (text, key) in TEMPLATES.items() for k, w in enumerate(_words(key)) if w != "_"]
    keys = spark.createDataFrame(key_words, "template string, place int, word string, n_key int")

    found = rows.where("words is not null")
    every_word = sorted({w for t, _ in TEMPLATES.values() for w in _words(t)})
    hits = save(found.select("row", F.posexplode("words").alias("at", "word")).where(F.col("word").isin(every_word)))
    starts = hits.join(F.broadcast(weight), "word").select("row", "template", (F.col("at") - F.col("place")).alias("start"), "idf")
    whole = weight.groupBy("template").agg(F.sum("idf").alias("all_idf"))
    agreed = starts.groupBy("row", "template", "start").agg(F.sum("idf").alias("idf")).join(F.broadcast(whole), "template").withColumn("share", F.col("idf") / F.col("all_idf")).where(F.col("share") >= least)
    wanted = agreed.join(F.broadcast(keys), "template").select("row", "template", "start", "share", "n_key", (F.col("start") + F.col("place")).alias("at"), "word")
    sure = wanted.join(hits, ["row", "at", "word"]).groupBy("row", "template", "start").agg(F.count("*").alias("n"), F.first("n_key").alias("n_key"), F.max("share").alias("share")).where("n = n_key")
    method = sure.groupBy("row").agg(F.collect_set("template").alias("more"), F.max("share").alias("share"))

    at = F.sequence(F.lit(0), F.size("words") - 1)
    places = F.array(*(_places(at, p) for p in BASE))
    based = found.select("row", places.alias("places")).select("row", F.flatten("places").alias("all"), F.array_compact(F.array(*(F.when(F.size(F.get("places", F.lit(k))) > 0, F.lit(label)) for k, label in enumerate(BASE.values())))).alias("base"))
    based = based.where(F.size("all") > 0).select("row", F.size("all").cast("long").alias("n_base"), F.array_min("all").cast("long").alias("first_word"), F.array_max("all").cast("long").alias("last_word"), "base")
    out = rows.select("doc_id", "row", "n_words").join(save(based), "row", "left").join(save(method), "row", "left")
    none = F.array().cast("array<string>")
    base, more = F.coalesce("base", none), F.coalesce("more", none)
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.concat_ws(",", F.array_sort(base)).alias("base_labels"), F.concat_ws(",", F.array_sort(F.array_union(base, more))).alias("labels"),
        F.least(F.lit(1.0), F.greatest(F.coalesce("share", F.lit(0.0)), F.when(F.size(base) > 0, 0.5).otherwise(0.0))).alias("score"),
    )


def _log_ratio(total: int, df: int) -> float:
    return math.log((1 + total) / (1 + df)) + 1.0
