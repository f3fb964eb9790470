"""License scans by exact set-similarity join, in DataFrame operations only.

A block is a run of as many consecutive words as a template has, over any line breaks; a text shorter than that is one block.
A block gets a template's label if it holds at least ``THRESHOLD`` of the template's distinct words.

Texts are cut into words once; of each document only the words of the templates' vocabulary and their places stay.  These are ordered
globally by how often they occur, rare ones first.  A block that meets the threshold must hold one of the template's first
``|T| - ceil(t|T|) + 1`` words, so those words of the documents are joined with the table of the templates' prefixes (prefix
filter).  A pair goes on if the vocabulary words around it are enough (length filter), and if those of them that
aren't rarer than the shared word are (positional filter: the rarest shared word has all others behind it, on both sides).  What is
left is verified.  The templates' tables are as small as their list and are joined like any other table; long lists make no long plans.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm._store import stored

#: The phrases that are always reported, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Wordings of license lines and their labels.
TEMPLATES = {
    "released under the mit license": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under the creative commons attribution 4 0 international license": "cc-by",
    "licensed under the mozilla public license version 2 0": "mpl-2.0",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved no part of this publication may be reproduced": "reserved",
}
THRESHOLD = 0.9

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_HITS = "array<struct<at:int,w:string>>"


def words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; everything above ASCII is a letter."""
    return F.filter(F.split(F.translate(text, _UPPER, _LOWER), f"{_GAP}+"), lambda w: w != "")


def vocabulary_places(docs: DataFrame, text: str, vocabulary: list[str], keep: list[str]) -> DataFrame:
    """``docs``' columns ``keep``, ``n_words``, and ``hits``: every place, in words from 0, of a word of ``vocabulary``."""
    cut = docs.select(*(F.col(f"`{c}`") for c in keep), F.split(F.coalesce(F.col(text), F.lit("")), f"{_GAP}+").alias("__words"))
    first = F.get("__words", F.lit(0)) == ""  # a text may begin and end with a gap
    w = F.col("__words")
    # Words above ASCII may fold into it, but are as long in bytes only if they are ASCII.
    known = lambda x: F.lower(x).isin(vocabulary) & (F.octet_length(x) == F.length(x))
    at = F.transform(w, lambda x, i: F.when(known(x), F.struct((i - F.when(first, 1).otherwise(0)).alias("at"), F.lower(x).alias("w"))))
    n = F.size(w) - F.when(first, 1).otherwise(0) - F.when((F.size(w) > 1) & (F.element_at(w, -1) == ""), 1).otherwise(0)
    return cut.select(*(F.col(f"`{c}`") for c in keep), n.cast("long").alias("n_words"), F.filter(at, lambda x: x.isNotNull()).alias("hits"))


def frequencies(rows: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """How often each word of the templates occurs in all documents."""
    counted = rows.select(F.explode("hits.w").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return dict.fromkeys(vocabulary, 0) | {r.w: r.n for r in counted.collect()}  # a row for each word of the templates


def ordered_templates(freq: dict[str, int], templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> list[tuple[str, list[str], int, int]]:
    """(label, distinct words with the rarest first, words needed, words in all) of each template."""
    out = []
    for wording, label in (templates or TEMPLATES).items():
        w = sorted(set(wording.split()), key=lambda x: (freq.get(x, 0), x))
        out.append((label, w, math.ceil(threshold * len(w) - 1e-9), len(wording.split())))
    return out


def contained(rows: DataFrame, ranked: list[tuple[str, list[str], int, int]], freq: dict[str, int]) -> DataFrame:
    """Rows ``(id, template, label, at, score)`` of ``rows(id, hits)``: a document's best block for each template that one meets, the first of equals."""
    spark = rows.sparkSession
    order = sorted(freq, key=lambda x: (freq[x], x))
    rank = {w: i for i, w in enumerate(order)}
    longest = max(n for *_, n in ranked)
    prefixes = spark.createDataFrame(
        [(w, rank[w], t, label, words_, need, n) for t, (label, words_, need, n) in enumerate(ranked) for w in words_[: len(words_) - need + 1]],
        "w string, rank int, template int, label string, words array<string>, need int, n int",
    )
    rare = sorted({w for _, words_, need, _ in ranked for w in words_[: len(words_) - need + 1]})
    # Each probe takes along the vocabulary words around it: hits are in order, so a slice as long as the longest template on each side holds all.
    near = lambda k: F.slice("hits", F.greatest(k - longest + 2, F.lit(1)), F.lit(2 * longest - 1))
    probes = F.filter(F.transform("hits", lambda h, k: F.when(h.w.isin(rare), F.struct(h.at.alias("at"), h.w.alias("w"), near(k).alias("near")))), lambda x: x.isNotNull())
    pairs = rows.where(F.size("hits") > 0).select("id", F.explode(probes).alias("p")).select("id", "p.*").join(prefixes, "w")
    window = F.filter("near", lambda h: (h.at > F.col("at") - F.col("n")) & (h.at < F.col("at") + F.col("n")) & F.array_contains("words", h.w))
    pairs = pairs.select("id", "template", "label", "words", "need", "n", "rank", window.alias("near")).where(F.size("near") >= F.col("need"))
    # The table of ranks is the words in order: a word's place in its template tells which are rarer.
    behind = F.slice("words", F.array_position("words", F.element_at(F.lit(order), F.col("rank") + 1)).cast("int"), F.size("words"))
    pairs = pairs.where(F.size(F.array_intersect(behind, F.transform("near", lambda h: h.w))) >= F.col("need"))
    inside = lambda s: F.size(F.array_distinct(F.transform(F.filter("near", lambda h: (h.at >= s.at) & (h.at < s.at + F.col("n"))), lambda h: h.w)))
    best = F.array_max(F.transform("near", lambda s: F.struct(inside(s).alias("held"), (-s.at).alias("back"))))
    found = pairs.withColumn("best", best).where(F.col("best.held") >= F.col("need"))
    whole = found.groupBy("id", "template").agg(F.first("label").alias("label"), F.max("best").alias("best"), F.first(F.size("words")).alias("size"))
    return whole.select("id", "template", "label", (-F.col("best.back")).alias("at"), (F.col("best.held") / F.col("size")).alias("score"))


def scan(
    docs: DataFrame,
    text: str = "text",
    keep: list[str] | None = None,
    phrases: dict[str, str] | None = None,
    templates: dict[str, str] | None = None,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``docs``' columns ``keep`` (all by default) with ``n_words``, ``places``, ``matches`` and ``score``.

    ``places`` are ``struct<label, at>`` of every place, in words from 0, where a phrase stands; ``matches`` are
    ``struct<at, label, score>`` of the best block for each template that one meets: the first word of the template in it, and the
    share of the template's words that it holds.  ``score`` is 1 with a place, else the best match's share, else 0.
    Null or empty texts have no words and no labels; an empty table gives no rows; repeated rows are scanned each; of equal
    blocks the first counts.  Columns of these names are replaced.
    """
    added = ["n_words", "places", "matches", "score"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    phrases = PHRASES if phrases is None else phrases
    names = [f"__keep_{i}" for i in range(len(keep))]
    vocabulary = sorted({w for t in [*(templates or TEMPLATES), *phrases] for w in t.split()})
    held = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)), F.col(text).alias("__text"))
    rows = stored(vocabulary_places(held, "__text", vocabulary, names).withColumn("id", F.monotonically_increasing_id()))
    freq = frequencies(rows, vocabulary)
    found = contained(rows, ordered_templates(freq, templates, threshold), freq)
    matches = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "label", "score"))).alias("matches"))  # at most one a template

    def stands(phrase: str, label: str) -> Column:
        parts = phrase.split()

        def here(h: Column, k: Column) -> Column:
            test = h.w == parts[0]
            for i, part in enumerate(parts[1:], 1):
                other = F.get("hits", k + i)
                test = test & (other.w == part) & (other.at == h.at + i)
            return F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(label).alias("label"), h.at.alias("at")))

        return F.filter(F.transform("hits", here), lambda x: x.isNotNull())

    places = F.array_sort(F.concat(*(stands(p, label) for p, label in phrases.items()))) if phrases else F.from_json(F.lit("[]"), "array<struct<label:string,at:int>>")
    out = rows.select(*names, "n_words", "id", places.alias("places")).join(matches, "id", "left")
    out = out.withColumn("matches", F.coalesce("matches", F.from_json(F.lit("[]"), "array<struct<at:int,label:string,score:double>>")))
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m.score)), F.lit(0.0))
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, keep)), "n_words", "places", "matches", F.when(F.size("places") > 0, 1.0).otherwise(best).alias("score"))
