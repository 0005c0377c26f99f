"""Licences, collocations and ranked search against spelled-out definitions."""

import math
import random
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path[:0] = [str(Path(__file__).resolve().parents[2]), str(Path(__file__).resolve().parents[1])]

from compare import connect, differences  # noqa: E402

from riskweave.llm import collocations, lexical, licences, registry  # noqa: E402

UPPER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def low(text):
    return (text or "").translate(UPPER)


# --- Licences ---------------------------------------------------------------------------------

LICENCE_TEXTS = [
    None,
    "",
    " .,-",
    "CC-BY cc by CC BY",
    "Licensed under CC BY-NC 4.0.",
    "all rights reserved all rights reserved",
    "All Rights\n\nRESERVED. GNU General Public License, version 3.",
    "This work is licensed under the GNU General Public License, version 3.",
    "the GNU General Public License version 3 alone",
    "Released under the MIT License.",
    "MIT License",
    "General Public Licence general public",
    "ccK by Kcc by éCC by cc byé cc by",  # a Kelvin sign is no k, other letters belong to words
    "CC BY İcc by",
    "word " * 20_000 + "all rights reserved " + "word " * 20_000,
    "cc by " * 3_000,
    "// Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
    "and associated documentation files (the Software), to deal in the Software without restriction",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of that software "
    "and associated documentation files (the Software), to deal in the Software without limits",
    "Licensed under the Apache License, Version 2.0",
]


def licence_rows(text):
    words = WORD.findall(low(text))
    base, labels, score = [], set(), 0.0
    for template in licences.TEMPLATES:
        parts, keys = template.words(), template.key_words()
        for start in range(-len(parts), len(words)):
            at = {k: words[start + k] if 0 <= start + k < len(words) else None for k in range(len(parts))}
            matched = sum(at[k] == parts[k] for k in at)
            if any(at[k] != w for k, w in keys.items()):
                continue
            if template.base:
                base.append((start, template.label))
            elif 100 * matched < licences.MIN_SHARE * len(parts):
                continue
            labels.add(template.label)
            score = max(score, matched / len(parts) * (1 - 2.0 ** -min(matched, 50)))
    starts = [s for s, _ in base]
    ends = (min(starts), max(starts)) if base else (None, None)
    names = ",".join(sorted({n for _, n in base}))
    return (len(words), len(base), *ends, names, ",".join(sorted(labels)), score)


def test_licences_equal_a_full_scan(spark):
    rows = [(k, t) for k, t in enumerate(LICENCE_TEXTS)] + [(3, LICENCE_TEXTS[3]), (None, LICENCE_TEXTS[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.withColumn("words", F.lit(1)).withColumn("places", F.lit("x"))
    got = [tuple(r) for r in licences.scan(df).collect()]
    want = [(k, *licence_rows(t)) for k, t in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert licences.scan(df.limit(0)).count() == 0


def test_the_frequencies_do_not_change_what_is_found(spark):
    rows = [(k, t) for k, t in enumerate(LICENCE_TEXTS)]
    words = licences.words_of(spark.createDataFrame(rows, "doc_id long, text string"))
    found = []
    for seed in range(2):
        rng = random.Random(seed)
        counts = {w: rng.randrange(9) for t in licences.TEMPLATES for w in t.words()}
        df = licences.places(words, licences.index(counts))
        found.append(sorted((r.doc_id, sorted(map(tuple, r.places))) for r in df.collect()))
    assert found[0] == found[1]


def test_licences_run_without_python(spark):
    df = spark.createDataFrame([(1, "cc by")], "doc_id long, text string")
    plan = licences.scan(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


# --- Collocations -----------------------------------------------------------------------------


def phrases_of(rows, count, least):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", low(text)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for m in range(1, 6):
                for k in range(len(words) - m + 1):
                    f[lang][tuple(words[k : k + m])] += 1
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if a >= least}
        found = []
        for p, a in often.items():
            if len(p) < 2:
                continue
            longer = (q for q, b in often.items() if len(q) > len(p) and b >= a)
            if any(q[k : k + len(p)] == p for q in longer for k in range(len(q))):
                continue
            cuts = [(1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:count], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def phrase_rows(seed, size=160):
    rng = random.Random(seed)
    common = "the of a to in".split()
    rare = [f"w{k}é" for k in range(40)]
    passages = [" ".join(rng.choice(rare + common) for _ in range(12)) for _ in range(4)]
    rows = []
    for k in range(size):
        parts = [" ".join(rng.choice(common if rng.random() < 0.6 else rare) for _ in range(rng.randrange(1, 12)))]
        parts += [rng.choice(passages)] * (k % 3 == 0)
        text = rng.choice([", ", "\t ", "\n", " "]).join(parts)
        rows.append((rng.choice(["en", "en", "fr", None]), text.upper() if k % 7 == 0 else text))
    return rows + [("en", None), (None, ""), ("und", "the of a"), ("de", "nur einmal"), ("xx", ". , .")]


@pytest.mark.parametrize(("count", "least"), [(2_000, 4), (7, 3)])
def test_collocations_equal_brute_force(spark, count, least):
    rows = phrase_rows(count)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    df = df.withColumn("phrase", F.lit("clash")).withColumn("n", F.lit(0))
    got = sorted(tuple(r) for r in collocations.collocations(df, count, least).collect())
    assert got == phrases_of(rows, count, least)


CUTS = {
    "small blocks": collocations.Sizes(block_bytes=300, bundle_words=100, flush=50, share_words=16),
    "a full sieve": collocations.Sizes(bits=7),  # nearly every place of the sieves is taken
}


@pytest.mark.parametrize("cut", CUTS.values(), ids=CUTS)
def test_how_the_work_is_cut_changes_nothing(spark, cut):
    rows = phrase_rows(9, 80)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(2)
    got = sorted(tuple(r) for r in collocations.collocations(df, 20, 3, cut).collect())
    assert got == phrases_of(rows, 20, 3)


def test_collocations_of_nothing(spark):
    df = spark.createDataFrame([("en", "a b")], "lang string, text string")
    assert collocations.collocations(df).count() == 0
    assert collocations.collocations(df.limit(0)).count() == 0


# --- Search -----------------------------------------------------------------------------------


def best(docs, items, count):
    texts = [(d, Counter(WORD.findall(low(t)))) for d, t in docs]
    total = sum(c.total() for _, c in texts)
    size = sum(c.total() > 0 for _, c in texts)
    df = Counter(t for _, c in texts for t in c)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(WORD.findall(low(text)))
    out = []
    for item, terms in asked.items():
        scores = []
        for doc, counts in texts:
            m = 50 + 50 * counts.total() * size // total if total else 0
            score = sum(
                math.floor(1000 * math.log((2 * size + 2) / (2 * df[t] + 1)))
                * (10**9 * counts[t] // (1000 * counts[t] + 20 * m))
                for t in terms
                if counts[t]
            )
            if score > 0:
                scores.append((-score, -1 if doc is None else doc))
        out += [
            (item, rank, None if doc < 0 else doc, -score)
            for rank, (score, doc) in enumerate(sorted(scores)[:count], 1)
        ]
    return sorted(out, key=repr)


def search_rows(seed, size=300):
    rng = random.Random(seed)
    words = [f"t{k}" for k in range(120)]
    weights = [1 / (k + 1) for k in range(120)]
    text = lambda n: " ".join(rng.choices(words, weights, k=n))
    docs = [(k, text(rng.randrange(1, 60))) for k in range(size)]
    docs += [(5, docs[5][1]), (7, text(9)), (None, text(20)), (900, None), (901, ""), (902, " ?! ")]
    docs += [(903, "T0 " * 5_000), (904, "T1É t1é T1")]
    items = [(k, text(rng.randrange(1, 25))) for k in range(12)]
    items += [(3, text(3)), (None, text(4)), (50, None), (51, "nowhere"), (52, ""), (53, "T1É t0")]
    return docs, items


@pytest.mark.parametrize(("count", "first"), [(50, 2_000), (5, 20), (1, 1), (10**6, 5)])
def test_search_equals_brute_force(spark, monkeypatch, count, first):
    monkeypatch.setattr(lexical, "FIRST_POSTINGS", first)
    monkeypatch.setattr(lexical, "GROWTH", 3)
    docs, items = search_rows(count)
    left = spark.createDataFrame(docs, "doc_id long, text string").withColumn("row", F.lit("clash"))
    right = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = sorted((tuple(r) for r in lexical.search(left, right, count).collect()), key=repr)
    assert got == best(docs, items, count)


def test_queries_are_answered_in_slices(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SLICE_TERMS", 40)
    docs, items = search_rows(1, 60)
    left = spark.createDataFrame(docs, "doc_id long, text string")
    right = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in lexical.search(left, right, 5).collect()), key=repr)
    assert got == best(docs, items, 5)


def test_search_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0


def test_accumulators_are_limited(spark, monkeypatch):
    """Documents that hold a frequent term alone never get an accumulator."""
    monkeypatch.setattr(lexical, "FIRST_POSTINGS", 10)
    written = {}
    store = lexical.store

    def counted(df, label):
        out = store(df, label)
        written[label] = out.count()
        return out

    monkeypatch.setattr(lexical, "store", counted)
    docs = [(k, "common " * 3 + ("rare " * 4 if k < 20 else "")) for k in range(2_000)]
    left = spark.createDataFrame(docs, "doc_id long, text string")
    right = spark.createDataFrame([(1, "common rare")], "item_id long, text string")
    got = lexical.search(left, right, 10).collect()
    assert [r.doc_id for r in got] == list(range(10))
    assert written["survivors"] == 20


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_registered_queries_equal_their_sql(spark, name):
    small = "/root/testdata/sf0.001"
    df = registry.queries()[name](spark, small)
    assert differences(df, connect(small), registry.oracle_sql()[name]) == []
