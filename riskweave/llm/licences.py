"""Licence notices found through a positional index of rare words.

Templates are short licence phrases and notices. Each has key words, which must all stand at their
places. Of these the one with the highest inverse document frequency over the corpus is indexed:
a file's licence words are looked up there, and every posting, a template and the word's place in
it, gives the place at which the template would begin. At that place all key words are verified by
their relative positions, and the template's other words are counted.

A template whose rarest key word is missing cannot be verified, so looking up only that word loses
nothing: the places found are exactly those of a full scan, whatever the frequencies are.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


class Template(NamedTuple):
    """Words of a notice, separated by spaces, and the phrases in it that must stand."""

    label: str
    text: str
    keys: tuple[str, ...]
    base: bool = False

    def words(self) -> list[str]:
        return self.text.split()

    def key_words(self) -> dict[int, str]:
        """Places of the key phrases' words in the text, and the words."""
        words, out = self.words(), {}
        for key in self.keys:
            parts = key.split()
            starts = [k for k in range(len(words)) if words[k : k + len(parts)] == parts]
            if not starts:
                raise ValueError(f"{key!r} is no phrase of {self.text!r}")
            out.update(enumerate(parts, start=starts[0]))
        return out


# The base phrases with their labels, then notices of widespread public licences.
BASE = (
    Template("cc-by", "cc by", ("cc by",), base=True),
    Template("gpl", "general public license", ("general public license",), base=True),
    Template("reserved", "all rights reserved", ("all rights reserved",), base=True),
)
NOTICES = (
    Template("mit", "released under the mit license", ("mit license",)),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software"
        " and associated documentation files the software to deal in the software without restriction",
        ("permission is hereby granted", "without restriction"),
    ),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template(
        "apache-2.0",
        "you may not use this file except in compliance with the license you may obtain a copy of the"
        " license at http www apache org licenses license 2 0",
        ("except in compliance with the license", "apache org licenses license 2 0"),
    ),
    Template(
        "gpl-2.0",
        "this work is licensed under the gnu general public license version 2",
        ("gnu general public license version 2",),
    ),
    Template(
        "gpl-3.0",
        "this work is licensed under the gnu general public license version 3",
        ("gnu general public license version 3",),
    ),
    Template(
        "lgpl",
        "under the terms of the gnu lesser general public license",
        ("gnu lesser general public license",),
    ),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Template(
        "cc-by-4.0",
        "this work is licensed under a creative commons attribution 4 0 international license",
        ("creative commons attribution 4 0 international",),
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted"
        " provided that the following conditions are met",
        ("source and binary forms", "conditions are met"),
    ),
    Template(
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        ("mozilla public license v 2 0",),
    ),
    Template(
        "cc0", "this work has been dedicated to the public domain", ("dedicated to the public domain",)
    ),
)
TEMPLATES = BASE + NOTICES
MIN_SHARE = 60  # percent of a notice's words that must stand at their places

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # letters and digits, before lower-casing
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _low(text: str) -> str:
    """SQL that lower-cases A-Z only."""
    return f"translate({text}, '{UPPER}', '{LOWER}')"


def _listed(words) -> str:
    return ", ".join(f"'{word}'" for word in sorted(words))


def words_of(documents: DataFrame) -> DataFrame:
    """``doc_id`` and the words of the whole text in page order, as they are spelled."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select("doc_id", F.regexp_extract_all(text, F.lit(f"({WORD})"), 1).alias("words"))


def document_frequencies(words: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[str, int]:
    """How many documents hold each key word; as many rows come back as the templates have words."""
    vocabulary = {word for t in templates for word in t.key_words().values()}
    held = f"array_distinct(filter(transform(words, w -> lower(w)), w -> w IN ({_listed(vocabulary)})))"
    counts = words.select(F.explode(F.expr(held)).alias("word")).groupBy("word").count()
    return dict(counts.collect())


def index(frequencies: dict[str, int], templates: tuple[Template, ...] = TEMPLATES) -> list[tuple[str, int]]:
    """Per template its key word of the highest IDF, which is the rarest, and the word's place."""
    out = []
    for template in templates:
        keys = template.key_words()
        place = min(keys, key=lambda k: (frequencies.get(keys[k], 0), k))
        out.append((keys[place], place))
    return out


def _literal(templates: tuple[Template, ...], rarest: list[tuple[str, int]]) -> str:
    """The templates with their postings as one SQL array."""
    rows = []
    for template, (word, place) in zip(templates, rarest, strict=True):
        keys = ", ".join(f"named_struct('at', {k}, 'word', '{w}')" for k, w in template.key_words().items())
        spelled = ", ".join(f"'{w}'" for w in template.words())
        rows.append(
            f"named_struct('label', '{template.label}', 'base', {str(template.base).lower()}, "
            f"'rare', '{word}', 'place', {place}, 'words', array({spelled}), 'keys', array({keys}))"
        )
    return f"array({', '.join(rows)})"


def places(words: DataFrame, rarest: list[tuple[str, int]], templates=TEMPLATES) -> DataFrame:
    """``words`` plus ``places``: label, base, start, matched and size of each verified template.

    Everything happens within a row: nothing is shuffled, whatever a document holds.
    """
    # Case is folded beyond ASCII here, which lets more through; the postings are exact.
    look_up = f"""filter(transform(words, (w, i) -> IF(lower(w) IN ({_listed({w for w, _ in rarest})}), i, NULL)),
                         i -> i IS NOT NULL)"""
    stands = f"{_low('get(words, i - t.place + k.at)')} <=> k.word"
    matched = f"size(filter(t.words, (w, k) -> {_low('get(words, i - t.place + k)')} <=> w))"
    found = f"""
        flatten(transform(looked_up, i -> transform(
            filter({_literal(templates, rarest)},
                   t -> t.rare = {_low('get(words, i)')} AND forall(t.keys, k -> {stands})),
            t -> named_struct('label', t.label, 'base', t.base, 'start', i - t.place,
                              'matched', {matched}, 'size', size(t.words)))))"""
    enough = f"filter(found, p -> p.base OR 100 * p.matched >= {MIN_SHARE} * p.size)"
    return (
        words.withColumn("looked_up", F.expr(look_up))
        .withColumn("found", F.expr(found))
        .withColumn("places", F.expr(enough))
        .drop("looked_up", "found")
    )


def scan(documents: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    Null and empty texts have no words, no places (null), empty labels and score 0. Repeated rows
    and null ids are answered one by one; further columns of ``documents`` are left out. The score
    is the largest, over the places, of the share of the template's words that stand there times
    1 - 2 ** -matched, so that a chance phrase of two words counts less than a whole notice.
    """
    words = words_of(documents)
    found = places(words, index(document_frequencies(words, templates), templates), templates)
    base = "filter(places, p -> p.base)"
    labels = "array_join(array_sort(array_distinct(transform({}, p -> p.label))), ',')"
    weight = "p.matched / p.size * (1 - pow(2.0D, -least(p.matched, 50)))"
    return found.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.expr(f"size({base})").cast("long").alias("n_base"),
        F.expr(f"array_min(transform({base}, p -> p.start))").cast("long").alias("first_word"),
        F.expr(f"array_max(transform({base}, p -> p.start))").cast("long").alias("last_word"),
        F.expr(labels.format(base)).alias("base_labels"),
        F.expr(labels.format("places")).alias("labels"),
        F.expr(f"coalesce(array_max(transform(places, p -> {weight})), 0.0D)").alias("score"),
    )


def op11_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices of every document."""
    return scan(table(spark, sf_dir, "documents", "doc_id", "text"))
