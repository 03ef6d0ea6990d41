"""License scans by diagonal voting, with DataFrame operations only.

Hashes of all runs of K words of a text are joined with the places of the same hashes in license
templates. A hit votes for its diagonal, place in the text minus place in the template. Votes are gathered
by diagonal, and diagonals that lie near each other merge (words put in or left out move a span to the
next), as far as a span may stretch. A merged span is verified word by word: the longest chain of its hits
that goes forward in text and template says which of the template's words stand there in order. Enough of
them must, and those that tell a license from its kin, as names and versions, all and side by side.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K = 4
#: Diagonals that may lie between neighbours of one span, in words.
GAP = 8
#: Words of a span beyond its template's: GAP, or the template's words by STRETCH if that is more.
STRETCH = 2
#: Template runs up to which their table is broadcast; beyond, the join shuffles.
BROADCAST_RUNS = 1_000_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases whose every place counts, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

Template = tuple[str, str, tuple[str, ...]]


def public_templates() -> list[Template]:
    """Statements and openings of public licenses: label, text, and phrases of it that must stand whole."""
    out: list[Template] = [
        ("mit", "Released under the MIT License", ("MIT License",)),
        ("mit", "Licensed under the MIT License", ("MIT License",)),
        ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ()),
        ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at", ()),
        ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ()),
        ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ()),
        ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ()),
        ("unlicense", "This is free and unencumbered software released into the public domain", ("public domain",)),
        ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ("GNU General Public License",)),
        ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright",)),
    ]
    out += [(f"apache-{v}", f"Licensed under the Apache License, Version {v}", (f"Apache License, Version {v}",)) for v in ("1.0", "1.1", "2.0")]
    out += [(f"epl-{v}", f"made available under the terms of the Eclipse Public License v{sep}{v}", (f"Eclipse Public License v{sep}{v}",)) for v in ("1.0", "2.0") for sep in (" ", "")]
    for v in ("1.0", "1.1", "2.0"):
        out += [(f"mpl-{v}", f"subject to the terms of the Mozilla Public License, {name} {v}", (f"Mozilla Public License, {name} {v}",)) for name in ("v.", "Version")]
    for code, name, versions in (("gpl", "General", ("1", "2", "3")), ("lgpl", "Lesser General", ("2.1", "3")), ("agpl", "Affero General", ("3",))):
        for v in versions:
            label, license_ = f"{code}-{v if '.' in v else v + '.0'}", f"GNU {name} Public License"
            out.append((label, f"licensed under the {license_}, version {v}", (f"{license_}, version {v}",)))
            out.append((label, f"under the terms of the {license_} as published by the Free Software Foundation, either version {v} of the License", (license_, f"version {v}")))
    for code, name in (("by", "Attribution"), ("by-sa", "Attribution-ShareAlike"), ("by-nc", "Attribution-NonCommercial"), ("by-nd", "Attribution-NoDerivatives"), ("by-nc-sa", "Attribution-NonCommercial-ShareAlike"), ("by-nc-nd", "Attribution-NonCommercial-NoDerivatives")):
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            out.append((f"cc-{code}-{v}", f"licensed under a Creative Commons {name} {v}", (f"Creative Commons {name} {v}",)))
            out.append((f"cc-{code}-{v}", f"licensed under CC {code} {v}", (f"CC {code} {v}",)))
    return out


TEMPLATES = public_templates()


def _split(text: str) -> list[str]:
    return re.findall(WORD, text.translate({c: c + 32 for c in range(65, 91)}))


def _needed(words: list[str], phrases: tuple[str, ...]) -> list[int]:
    """Places of words of the phrases, each of which must stand right before the next one."""
    out = set()
    for phrase in map(_split, phrases):
        first = next(k for k in range(len(words)) if words[k : k + len(phrase)] == phrase)
        out.update(range(first, first + len(phrase) - 1))
    return sorted(out)


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _run_hash(words: Column, start: Column) -> Column:
    return F.xxhash64(F.array_join(F.slice(words, start + 1, K), " "))


def template_table(spark: SparkSession, templates: list[Template] = TEMPLATES) -> DataFrame:
    """``template, label, words array<string>, needed array<int>``; a template has K words or more."""
    rows = [(k, label, words, _needed(words, phrases)) for k, (label, text, phrases) in enumerate(templates) if len(words := _split(text)) >= K]
    return spark.createDataFrame(rows, "template int, label string, words array<string>, needed array<int>")


def _longest_chain(hits: Column) -> Column:
    """The longest chain of hits (``pos, back``: minus the place) that goes forward in text and template.

    A struct ``n, first, last, place, places``; of equally long ones that which starts latest. The hits
    of a window are at most a few times a template's words.
    """
    one = lambda h: F.struct(F.lit(1).alias("n"), h["pos"].alias("first"), h["pos"].alias("last"), (-h["back"]).alias("place"), F.array(-h["back"]).alias("places"))
    longer = lambda c, h: F.struct((c["n"] + 1).alias("n"), c["first"], h["last"].alias("last"), h["place"].alias("place"), F.concat(c["places"], h["places"]).alias("places"))

    def step(chains: Column, h: Column) -> Column:
        before = F.transform(F.filter(chains, lambda c: c["place"] < h["place"]), lambda c: longer(c, h))
        return F.concat(chains, F.array(F.coalesce(F.array_max(before), h)))

    kind = "array<struct<n:int,first:int,last:int,place:int,places:array<int>>>"
    return F.array_max(F.aggregate(F.transform(hits, one), F.array().cast(kind), step))


def spans(docs: DataFrame, least_share: float = 0.6, templates: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Verified spans: ``id, copy, template, label, first_word, last_word, share``.

    ``templates``: a table as :func:`template_table` makes it, of any size. ``share`` is that of the
    template's words that the span has in order. Null and empty texts have none; rows that repeat id and
    text count as one.
    """
    known = template_table(docs.sparkSession) if templates is None else templates
    known = known.withColumns({"n_words": F.size("words"), "reach": F.greatest(F.lit(GAP), F.floor(F.size("words") / (2 * STRETCH)).cast("int"))})
    places = known.select("template", "reach", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("words") - K), lambda i: _run_hash(F.col("words"), i))).alias("place", "hash"))
    if places.count() <= BROADCAST_RUNS:
        places = F.broadcast(places)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("copy"), F.regexp_extract_all(_lower(text), F.lit(f"({WORD})"), 1).alias("words"))
    hashes = F.when(F.size("words") >= K, F.transform(F.sequence(F.lit(0), F.size("words") - K), lambda i: _run_hash(F.col("words"), i)))
    hits = rows.select("id", "copy", F.posexplode(hashes).alias("pos", "hash")).join(places, "hash")
    point = F.struct("pos", (-F.col("place")).alias("back"))
    votes = hits.withColumn("diagonal", F.col("pos") - F.col("place")).groupBy("id", "copy", "template", "reach", "diagonal").agg(F.collect_set(point).alias("hits"))
    # a chain of neighbouring diagonals, seen through windows of twice the reach, each half over the last
    order = Window.partitionBy("id", "copy", "template").orderBy("diagonal")
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > GAP, F.lit(True))
    chained = votes.withColumn("fresh", fresh).withColumn("start", F.last(F.when(F.col("fresh"), F.col("diagonal")), ignorenulls=True).over(order))
    half = F.floor((F.col("diagonal") - F.col("start")) / F.col("reach")).cast("int")
    windows = chained.withColumn("window", F.explode(F.when(half > 0, F.array(half - 1, half)).otherwise(F.array(half))))
    merged = windows.groupBy("id", "copy", "template", "start", "window").agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"))
    about = known.select("template", "label", "n_words", "reach", "needed")
    merged = merged.join(F.broadcast(about) if places.count() <= BROADCAST_RUNS else about, "template").where(F.size("hits") * K >= least_share * F.col("n_words"))
    chain = merged.select("id", "copy", "template", "label", "n_words", "reach", "needed", _longest_chain(F.col("hits")).alias("chain"))
    sofar = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    held = F.aggregate("chain.places", sofar, lambda a, p: F.struct((a["n"] + p + K - F.greatest(p, a["end"])).alias("n"), (p + K).alias("end")))["n"]
    whole = F.forall("needed", lambda i: F.exists("chain.places", lambda p: (p <= i) & (i + 1 < p + K)))
    found = chain.select("id", "copy", "template", "label", F.col("chain.first").alias("first_word"), (F.col("chain.last") + K - 1).alias("last_word"), (held / F.col("n_words")).alias("share"), "n_words", "reach", whole.alias("whole"))
    fits = F.col("last_word") - F.col("first_word") + 1 <= F.col("n_words") + STRETCH * F.col("reach")
    return found.where(F.col("whole") & fits & (F.col("share") >= least_share)).drop("n_words", "reach", "whole").distinct()


def license_scan(docs: DataFrame, least_share: float = 0.6, templates: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of every row.

    ``n_base`` counts the places of the phrases in BASE; ``first_word`` and ``last_word`` are their
    smallest and largest start, null without one. ``labels`` adds those of verified template spans.
    ``score`` is 1 with a base phrase, else the best span's share, else 0. A null or empty text has no
    words. Rows that repeat id and text get the same result, each its own row.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.regexp_extract_all(_lower(text), F.lit(f"({WORD})"), 1)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("copy"), words.alias("words"))
    joined = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    rows = rows.select("id", "copy", F.size("words").cast("bigint").alias("n_words"), joined.alias("joined"))
    # words before a place are the blanks before it; a text without the phrase is one piece
    blanks = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" ")))
    by_phrase = []
    for phrase in BASE:
        pieces = F.split("joined", f" {phrase}(?= )", -1)
        after = blanks(F.element_at(pieces, -1)) - 1
        place = F.struct((F.size(pieces) - 1).alias("n"), blanks(pieces[0]).alias("first"), (F.col("n_words") - after - len(phrase.split())).alias("last"))
        by_phrase.append(F.when(F.contains("joined", F.lit(f" {phrase} ")), place))
    rows = rows.select("id", "copy", "n_words", F.array(*by_phrase).alias("by_phrase"))
    held = F.array_compact("by_phrase")
    base = F.array_compact(F.array(*(F.when(F.col("by_phrase")[k].isNotNull(), F.lit(label)) for k, label in enumerate(BASE.values()))))
    rows = rows.select("id", "copy", "n_words", F.aggregate(held, F.lit(0), lambda n, x: n + x["n"]).cast("bigint").alias("n_base"), F.array_min(held["first"]).cast("bigint").alias("first_word"), F.array_max(held["last"]).cast("bigint").alias("last_word"), base.alias("base"))
    found = spans(docs, least_share, templates, id_col, text_col).groupBy("id", "copy").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
    found = found.withColumnsRenamed({"id": "id_found", "copy": "copy_found"})
    both = rows.join(found, rows["id"].eqNullSafe(found["id_found"]) & (rows["copy"] == found["copy_found"]), "left")
    every = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))))
    return both.select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"))


def license_sql(least_share: float = 0.6, templates: list[Template] = TEMPLATES) -> str:
    """DuckDB: the same counts, spans and labels from lists of words."""
    split = [(k, label, words, _needed(words, phrases)) for k, (label, text, phrases) in enumerate(templates) if len(words := _split(text)) >= K]
    rows = ", ".join(f"({k}, '{label}', {words}, {needed}::INT[])" for k, label, words, needed in split)
    phrases = ", ".join(f"('{p}', {len(p.split())}, '{label}')" for p, label in BASE.items())
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH t AS (
  SELECT *, len(w) AS n, greatest({GAP}, len(w) // {2 * STRETCH}) AS reach FROM (VALUES {rows}) v(template, label, w, needed)
), g AS (
  SELECT template, reach, place, array_to_string(w[place + 1:place + {K}], ' ') AS run FROM (SELECT *, unnest(range(len(w) - {K - 1})) AS place FROM t)
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{WORD}') AS w FROM documents
), hit AS (
  SELECT doc_id, template, reach, pos, place, pos - place AS diagonal FROM (SELECT doc_id, w, unnest(range(len(w) - {K - 1})) AS pos FROM d) x JOIN g ON array_to_string(w[pos + 1:pos + {K}], ' ') = run
), voted AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= {GAP} THEN NULL ELSE diagonal END AS fresh FROM (SELECT DISTINCT doc_id, template, reach, diagonal FROM hit)
), chained AS (
  SELECT *, last_value(fresh IGNORE NULLS) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS start FROM voted
), windows AS (
  SELECT *, unnest(CASE WHEN h > 0 THEN [h - 1, h] ELSE [h] END) AS part FROM (SELECT *, (diagonal - start) // reach AS h FROM chained)
), merged AS (
  SELECT doc_id, template, start, part, list({{'n': 1, 'first': pos, 'last': pos, 'place': place, 'places': [place]}} ORDER BY pos, place DESC) AS hits
  FROM windows JOIN hit USING (doc_id, template, diagonal) GROUP BY doc_id, template, start, part
), longest AS (
  SELECT doc_id, template, list_max(list_reduce(list_transform(hits, lambda h: [h]), lambda acc, h: list_append(acc, coalesce(list_max(list_transform(list_filter(acc, lambda c: c.place < h[1].place),
    lambda c: {{'n': c.n + 1, 'first': c.first, 'last': h[1].last, 'place': h[1].place, 'places': list_append(c.places, h[1].place)}})), h[1])))) AS c FROM merged
), found AS (
  SELECT doc_id, label, len(list_distinct(flatten(list_transform(c.places, lambda p: range(p, p + {K}))))) / n AS share FROM longest JOIN t USING (template)
  WHERE len(list_filter(needed, lambda i: len(list_filter(c.places, lambda p: p <= i AND i + 1 < p + {K})) = 0)) = 0 AND c.last + {K} - c.first <= n + {STRETCH} * reach AND share >= {least_share}
), more AS (
  SELECT doc_id, list(label) AS labels, max(share) AS share FROM found GROUP BY doc_id
), base AS (
  SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(label) AS labels
  FROM (SELECT doc_id, w, unnest(range(len(w))) AS pos FROM d) x JOIN (VALUES {phrases}) p(phrase, n, label) ON array_to_string(w[pos + 1:pos + n], ' ') = phrase GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  array_to_string(list_sort(list_distinct(coalesce(base.labels, []))), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)"""
