"""License scans: phrases at their places, and notices by an exact set-similarity join of text blocks with templates.

A block is a window of 2 * STEP words, one every STEP words, so that any notice of up to STEP words lies whole in one.
A template is held by a block that has LEAST or more of the template's different words.

1. The templates' words are counted over all documents, which puts words in one global order, the rarest first.
2. A second scan places the phrases and cuts blocks. Of templates that a block holds, the words that come first in the order, one more
   than may be missing, cannot all be missing (prefix filter): a block without any such word of any template is passed over, and
   of the others the templates' words are kept, in order.
3. Blocks' prefixes are joined with templates' prefixes by the word. A pair lives on if the block has enough words at all (length
   filter), and if what stands after their first common word in either can still make up the number (positional filter). Pairs
   that live on are verified on their whole sets.

No filter loses a pair that meets the threshold, so the join is exact. score is 1 with a phrase, else the greatest share of a template that a
block holds, if LEAST or more, else 0.

Bounds: templates and phrases are parameters, at most STEP words each; tasks hold one batch of texts, and the words of SEGMENT blocks. The
join carries blocks that hold a rare word of a template, never texts, and only documents with such blocks are joined.

Defined results: null and empty texts have no words and no labels; texts of any length are read whole; repeated rows, null ids and ids that
repeat each get a row of their own; labels of several templates are put together; an empty table gives no rows; columns beside doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, bound_batches, raw_texts, written
from .lexical_search import TABLE, pieces

LEAST, STEP, SEGMENT = 0.8, 40, 4096  # SEGMENT: blocks of a text that are handled at a time

#: Fixed values of the query's contract: phrase and label.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Opening words of well-known notices and their labels.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl", "This work is licensed under the GNU General Public License"),
    ("gpl", "under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("isc", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
]


def words_of(text: str) -> list[bytes]:
    """Words by the contract's pattern: ASCII letters, digits and all that is not ASCII, A-Z as a-z."""
    return text.encode().translate(TABLE).split()


def needed(n: int, least: float) -> int:
    """The fewest of n words that make a share of least."""
    return max(1, math.ceil(least * n - 1e-9))


class Scan:
    """Phrases, and templates' words in the global order."""

    def __init__(self, phrases: dict[str, str], templates: list[tuple[str, str]], least: float, counts: dict[bytes, int]):
        self.phrases = [(b" " + b" ".join(words_of(p)) + b" ", label) for p, label in phrases.items()]
        sets = [(label, set(words_of(t))) for label, t in templates]
        self.rank = {w: i for i, w in enumerate(sorted({w for _, s in sets for w in s}, key=lambda w: (counts.get(w, 0), w)))}
        self.templates = [(label, sorted(self.rank[w] for w in s)) for label, s in sets if s]
        self.need = [needed(len(s), least) for _, s in self.templates]
        self.prefixes = [s[: len(s) - n + 1] for (_, s), n in zip(self.templates, self.need, strict=True)]
        rare = {r for p in self.prefixes for r in p}
        self.rare = {w for w, r in self.rank.items() if r in rare}

    def base(self, words: list[bytes], own: int) -> tuple[list[int], set[str]]:
        """(first words of all places, labels) of the phrases that begin in the first `own` words."""
        joined, places, labels = b" " + b" ".join(words) + b" ", [], set()
        for phrase, label in self.phrases:
            at = joined.find(phrase)
            last, word = 0, 0
            while at >= 0 and (word := word + joined.count(b" ", last, at)) < own:
                labels.add(label)
                places.append(word)
                last, at = at, joined.find(phrase, at + 1)
        return places, labels

    def blocks(self, words: list[bytes], starts: range, step: int) -> Iterator[list[int]]:
        """Ranks, in order, of the templates' words in each block that has a rare one."""
        if self.rare.isdisjoint(words):
            return
        for at in starts:
            own = set(words[at : at + 2 * step])
            if not self.rare.isdisjoint(own):
                yield sorted(self.rank[w] for w in own & self.rank.keys())

    def text(self, text: bytes, step: int, segment: int) -> tuple:
        """A row of SCANNED."""
        n, places, labels, blocks = 0, [], set(), []
        for at, words, own in segments(text, step * segment, step):
            found, names = self.base(words, own)
            places += [at + x for x in found]
            labels |= names
            last = own == len(words)  # the last block of a text begins where more than a step of words is left
            blocks += self.blocks(words, range(0, max(1 if not at else 0, own - step) if last else own, step), step)
            n += own
        return n, len(places), min(places, default=None), max(places, default=None), sorted(labels), blocks


def segments(text: bytes, size: int, more: int) -> Iterator[tuple[int, list[bytes], int]]:
    """(first word, words, number of own words): own words are `size` but at the end, `more` words of the next follow."""
    held, at = [], 0
    for p in pieces(text):
        held += p.split()
        while len(held) > size + more:
            yield at, held[: size + more], size
            held, at = held[size:], at + size
    yield at, held, len(held)


def counted(docs: DataFrame, words: set[bytes]) -> dict[bytes, int]:
    """How often each of these words stands in all texts: each task sums up its own, Spark the tasks'."""

    def run(batches):
        total: Counter = Counter()
        for b in batches:
            for t in raw_texts(b.column(0)):
                for p in pieces(t):
                    c = Counter(p.split())
                    total.update({w: c[w] for w in c.keys() & words})
        found = sorted(total.items())
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.binary()), pa.array([n for _, n in found], pa.int64())], ["word", "n"])

    rows = docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r.word): r.n for r in rows}


SCANNED = "n_words long, n_base long, first_word long, last_word long, base array<string>, blocks array<array<int>>"


def scanned(docs: DataFrame, scan: Scan, step: int, segment: int) -> DataFrame:
    """doc_id and SCANNED for each row."""
    spark = docs.sparkSession
    ddl = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {SCANNED}"
    schema = arrow_schema(spark, ddl)

    def run(batches):
        for b in batches:
            rows = [scan.text(t, step, segment) for t in raw_texts(b.column(1))]
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True))], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, ddl)


def held(rows: DataFrame, scan: Scan, labels: str = "found") -> DataFrame:
    """row, found (labels), share of the rows (row, blocks) that hold a template: the set-similarity join."""
    spark = rows.sparkSession
    sides = [(label, words, need, p, i) for (label, words), need, prefix in zip(scan.templates, scan.need, scan.prefixes, strict=True) for i, p in enumerate(prefix)]
    templates = spark.createDataFrame(sides, "label string, t array<int>, need int, word int, t_at int")
    fewest = min(scan.need, default=1)
    blocks = rows.select("row", F.explode("blocks").alias("b")).where(F.size("b") >= fewest).withColumn("prefix", F.slice("b", 1, F.size("b") - fewest + 1))
    met = blocks.select("row", "b", F.posexplode("prefix").alias("b_at", "word")).join(templates, "word")
    met = met.where((F.size("b") >= F.col("need")) & (F.col("b_at") <= F.size("b") - F.col("need")))
    # the first common word of a pair is the one with the least place in both
    first = met.groupBy("row", "b", "label", "t", "need").agg(F.min(F.struct("t_at", "b_at")).alias("at"))
    after = F.least(F.size("t") - F.col("at.t_at"), F.size("b") - F.col("at.b_at"))
    shared = F.size(F.array_intersect("t", "b"))
    sure = first.where(after >= F.col("need")).withColumn("shared", shared).where(F.col("shared") >= F.col("need"))
    return sure.groupBy("row").agg(F.collect_set("label").alias(labels), F.max(F.col("shared") / F.size("t")).alias("share"))


def license_scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST, step: int = STEP, segment: int = SEGMENT) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of docs."""
    bound_batches(docs.sparkSession)
    long = [t for t in (*phrases, *(t for _, t in templates)) if len(words_of(t)) > step]
    if long:
        raise ValueError(f"phrases or templates of more than {step} words: {long}")
    words = {w for _, t in templates for w in words_of(t)}
    scan = Scan(phrases, templates, least, counted(docs, words))
    rows = written(scanned(docs, scan, step, segment).withColumn("row", F.monotonically_increasing_id()), "scanned")
    some = F.size("blocks") > 0
    own = rows.where(some)
    joined = own.join(held(own.select("row", "blocks"), scan), "row", "left").unionByName(rows.where(~some), allowMissingColumns=True)
    labels = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0)))
    return joined.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))


def _oracle() -> str:
    words = r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    templates = ", ".join(f"({quoted(label)}, {quoted(t)})" for label, t in TEMPLATES)
    phrases = ", ".join(f"({quoted(p)}, {quoted(label)})" for p, label in PHRASES.items())
    return f"""
WITH d AS (SELECT doc_id, {words.format('text')} AS w FROM documents),
t AS (SELECT label, list_distinct({words.format('x')}) AS t FROM (VALUES {templates}) AS v(label, x)),
p AS (SELECT label, string_split(x, ' ') AS p FROM (VALUES {phrases}) AS v(x, label)),
i AS (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM d),
b AS (SELECT doc_id, label, i FROM i JOIN p ON w[i + 1 : i + len(p)] = p),
n AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY doc_id),
k AS (SELECT doc_id, list_distinct(w[x + 1 : x + {2 * STEP}]) AS k FROM (SELECT doc_id, w, unnest(range(0, greatest(1, len(w) - {STEP}), {STEP})) AS x FROM d)),
h AS (SELECT doc_id, label, len(list_intersect(k, t)) / len(t) AS share FROM k, t),
l AS (SELECT doc_id, label, share FROM h WHERE share >= {LEAST} - 1e-9 UNION ALL SELECT doc_id, label, 1.0 FROM b),
g AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM l GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN g USING (doc_id)"""


#: Phrases place by place, templates by brute force over all blocks.
ORACLE = _oracle()


def query(spark, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
