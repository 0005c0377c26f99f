"""Operators on texts against spelled-out definitions, on small and awkward inputs."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from riskweave.llm import bpe, graph, language, minhash, packing, quality, suffix, toxicity, vocabulary

SCHEMA = "doc_id long, text string"
SMALL = "/root/testdata/sf0.001"
ODD = ["", " ", "a  b", "a \n b", "x's don't  'll", "　 a  b", "tab\t x", "é 1 $", "a\x1c b"]


def words(seed, count):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefg", k=rng.randint(2, 7))) for _ in range(count))


@pytest.fixture(scope="module")
def awkward(spark):
    base = words(1, 300)
    near = base.split()
    near[100] = "changed"
    texts = [base, base.upper(), " ".join(near), words(2, 120), "one two", "one two", None, "", " \n"]
    texts += [base[50:800] + words(3, 40), "ab" * 400, "é" * 300 + words(4, 9), words(5, 8000)]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, "one two"), (None, None), *(
        (100 + k, t) for k, t in enumerate(ODD)
    )]
    return rows, spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("clash")).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_encoding_in_parts_equals_the_libraries():
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choices(" \n\tab'sé1$\x1d", k=rng.randrange(30))) for _ in range(500)]
    for text, ids in zip(texts, vocabulary.Encoder()(texts), strict=True):
        whole = vocabulary.tokenizer().encode(text, add_special_tokens=False).ids
        assert ids.tolist() == whole == vocabulary.encoding().encode_ordinary(text)


def test_minhash_equals_brute_force(awkward):
    rows, df = awkward
    sets = collections.defaultdict(set)
    for i, text in rows:
        w = (text or "").encode().lower().split()
        if i is not None and w:
            sets[i] |= {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    lowest = {i: i for i, _ in rows if i is not None}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    lowest[a] = min(lowest[a], lowest[b])
    got = minhash.deduplicate(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == lowest.get(r.doc_id) and r.kept == (
            r.doc_id is not None and lowest[r.doc_id] == r.doc_id
        )


@pytest.fixture(scope="module")
def crowd():
    base = [f"w{k}" for k in range(300)]
    rng = random.Random(8)

    def changed(places, tag):
        return " ".join(f"{tag}x{k}" if k in places else w for k, w in enumerate(base))

    texts = []
    for k in range(300):  # about 0.71 to each other
        places = rng.sample(range(4, 290, 12), 5)
        shift = rng.randrange(8)
        texts.append(changed({p + shift for p in places}, f"a{k}"))
        if k < 40:  # a copy at about 0.81, whose words of its own nobody shares
            texts.append(changed({p + shift + 1 for p in places}, f"b{k}"))
    rng.shuffle(texts)
    sets = [set(zip(*(t.split()[k:] for k in range(5)))) for t in texts]
    want = list(range(len(sets)))
    links = [
        (a, b)
        for a in range(len(sets))
        for b in range(a)
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    for _ in range(20):
        for a, b in links:
            want[a] = want[b] = min(want[a], want[b])
    assert 40 <= len(links) and len(set(want)) > 200
    return texts, want


def test_minhash_links_copies_within_a_crowd(spark, crowd):
    texts, want = crowd
    got = minhash.deduplicate(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()
    assert [r.component_id for r in sorted(got)] == want


def test_texts_of_a_repeated_id_are_one_document(spark):
    rows = [(3, words(1, 60)), (5, words(1, 60)), (5, words(2, 60)), (4, words(2, 60)), (6, words(4, 60))]
    rows += [(6, words(5, 60)), (9, words(3, 60))]
    got = minhash.deduplicate(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(3, 3), (4, 3), (5, 3), (5, 3), (6, 6), (6, 6), (9, 9)]


def test_large_buckets_lose_no_link(spark, crowd):
    texts, want = crowd
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    # Buckets of everything, as bands make them in a crowd; 340 members are two blocks.
    members = df.select(F.col("doc_id").alias("id"), F.explode(F.array(F.lit(3), F.lit(8))).alias("key"))
    links = minhash._links(df, members.withColumn("key", F.col("key").cast("long")), 5, 80)
    got = {r.node: r.component for r in graph.components(links).collect()}
    assert [got.get(k, k) for k in range(len(texts))] == want


def test_blocks_of_a_bucket_compare_all_that_are_apart(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    rng = random.Random(9)
    made = [set(rng.sample(range(12), 10)) for _ in range(40)]
    texts = [" ".join(f"w{k}" for k in sorted(s)) for s in made]
    rest = spark.createDataFrame([(1, k, 40, k // 2) for k in range(40)], "key long, id long, size long, label long")
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = minhash._met_in_blocks(rest, df, 1, 80).collect()
    up = list(range(40))
    want = list(range(40))
    for _ in range(40):
        for a, b in got:
            up[a] = up[b] = min(up[a], up[b])
        for a in range(40):
            for b in range(a):
                if a // 2 != b // 2 and 100 * len(made[a] & made[b]) >= 80 * len(made[a] | made[b]):
                    want[a] = want[b] = min(want[a], want[b])
    assert up == want and len(got) > 0


def test_repeats_equal_brute_force(awkward):
    rows, df = awkward
    count = collections.Counter()
    for _, text in rows:
        data = (text or "").encode()
        count.update(data[p : p + 200] for p in range(len(data) - 199))
    want = []
    for i, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - 199):
            if count[data[p : p + 200]] > 1:
                gone[p : p + 200] = True
        left = bytes(np.frombuffer(data, np.uint8)[~gone])
        want.append((repr(i), hashlib.sha256(left).hexdigest()))
    got = [
        (repr(r.doc_id), hashlib.sha256(suffix.remaining(r.text, r.spans)).hexdigest())
        for r in suffix.repeats(df).collect()
    ]
    assert sorted(got) == sorted(want)


def test_ends_of_matches_are_looked_up_in_blocks(spark, monkeypatch):
    stored, store = {}, suffix.store

    def noted(df, label):
        stored[label] = store(df, label)
        return stored[label]

    monkeypatch.setattr(suffix, "store", noted)
    shared = [words(k, 250) for k in range(5)]
    rng = random.Random(11)
    texts = []
    for k in range(60):
        begin, size = rng.randrange(300), rng.randrange(150, 700)
        texts.append(words(100 + k, 20) + shared[k % 5][begin : begin + size] + words(300 + k, 20))
    texts += [texts[0], texts[1]]
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    count = collections.Counter(t[p : p + 200] for t in texts for p in range(len(t) - 199))
    got = {r.doc_id: suffix.remaining(r.text, r.spans) for r in suffix.repeats(df).collect()}
    for k, text in enumerate(texts):
        gone = np.zeros(len(text), bool)
        for p in range(len(text) - 199):
            if count[text[p : p + 200]] > 1:
                gone[p : p + 200] = True
        assert got[k] == bytes(np.frombuffer(text.encode(), np.uint8)[~gone])
    # Two ends of a match, each in a few blocks of 16; runs have up to 151 strings.
    asked = stored["blocks"].agg(F.sum("count")).first()[0]
    assert 0 < stored["looked"].count() < asked / 2


def _workers_of_a_task(plan, above=0):
    """Python functions that run in one stage, one after the other, at most."""
    name = plan.nodeName()
    above = 0 if "Exchange" in name else above + name.startswith(("MapIn", "FlatMap"))
    below = plan.children()
    return max([above, *(_workers_of_a_task(below.apply(k), above) for k in range(below.size()))])


def test_a_task_has_one_worker_at_a_time(spark, awkward, tmp_path):
    rows, df = awkward
    docs = df.select(
        "doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").alias("n_chars")
    )
    docs.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    for made in (
        corpus_pipeline.cut_repeats(spark, docs, ""),
        suffix.op2_suffix_array(spark, str(tmp_path)),
        suffix.repeats(df),
    ):
        plan = made._jdf.queryExecution().executedPlan()
        assert _workers_of_a_task(plan.initialPlan()) == 1
    left = {(repr(r.doc_id), r.text) for r in corpus_pipeline.cut_repeats(spark, docs, "").collect()}
    assert left == {
        (repr(r.doc_id), suffix.remaining(r.text, r.spans).decode(errors="ignore"))
        for r in suffix.repeats(df).collect()
    }


def test_levels_grow_geometrically(spark):
    family = suffix.IndexFamily()
    for k in range(4):
        family.add(spark.createDataFrame([(k, 7), (k, 100 + k)], "row long, seed long"))
    assert [size for size, _ in family.levels] == [4]
    assert [r.seed for r in family.seeds().collect()] == [7]


def test_packing_gives_every_id_once(awkward):
    rows, df = awkward
    got = packing.pack(df).toPandas()
    assert got["sequence_id"].is_unique and set(got["length"]) <= {1 << k for k in range(11)}
    assert (got["offset"] == 0).all() and got["length"].sum() == sum(
        len(vocabulary.encoding().encode_ordinary(t or "")) + 1 for _, t in rows
    )
    long = got[got["doc_id"] == 12].sort_values("start")
    whole = vocabulary.encoding().encode_ordinary(rows[12][1]) + [0]
    assert np.frombuffer(b"".join(long["tokens"]), "<u4").tolist() == whole
    assert long["ids_crc32"].tolist() == [zlib.crc32(t) for t in long["tokens"]]


def test_frequent_words_are_encoded_once(monkeypatch):
    monkeypatch.setattr(vocabulary, "REMEMBERED", 500)
    whole, asked = vocabulary.tokenizer(), []

    class Counting:
        def encode_batch_fast(self, lines, **named):
            asked.extend(lines)
            return whole.encode_batch_fast(lines, **named)

    encode = vocabulary.Encoder()
    monkeypatch.setattr(vocabulary, "tokenizer", lambda name: Counting())
    texts = []
    for k in range(30):  # some words stand in all texts, the others in one only
        rare = [f"rare{k}x{j}é" for j in range(60)]
        texts.append(" ".join(["first", *(f"common{j}" for j in range(40)), *rare, "\n\nend\n"]))
        texts.append(f"  odd\t white {k}  space \n{rare[0]}. ")
    for at in range(0, len(texts), 2):
        for text, ids in zip(texts[at : at + 2], encode(texts[at : at + 2]), strict=True):
            assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids
        assert len(encode._after_space.numbers) + len(encode._known.numbers) <= 500 + 130
    words = [word for line in asked for word in line.split(" ")]
    assert words.count("common7") == 1 and words.count("rare7x7é") == 1


def test_packing_holds_a_few_texts_at_a_time(awkward, monkeypatch):
    _, df = awkward
    run, asked = [], []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: run.append(f) or self)
    packing.pack(df)
    encode = vocabulary.Encoder()
    monkeypatch.setattr(packing, "_encoder", lambda: lambda texts: asked.append(len(texts)) or encode(texts))
    ids, texts = [*range(599), None], [words(k, 9) for k in range(599)] + [None]
    out = pa.Table.from_batches(run[0]([pa.RecordBatch.from_pydict({"doc_id": ids, "text": texts})]))
    assert sum(asked) == 600 and max(asked) <= 256
    assert set(out["doc_id"].to_pylist()) == set(ids)
    assert out["length"].to_numpy().sum() == sum(len(x) + 1 for x in encode([t or "" for t in texts]))


def test_buckets_hold_one_length_each(spark, awkward, tmp_path):
    _, df = awkward
    packed = packing.pack(df)
    packing.bucket(packed, str(tmp_path / "out"))
    wanted = sorted((r.length, r.ids_crc32) for r in packed.collect())
    got = []
    for folder in (tmp_path / "out").glob("length=*"):
        length = int(folder.name.removeprefix("length="))
        got += [(length, r.ids_crc32) for r in spark.read.parquet(str(folder)).collect()]
    assert sorted(got) == wanted
    assert len({length for length, _ in wanted}) > 1


def test_bpe_round_trip(awkward):
    rows, df = awkward
    got = bpe.decode(bpe.encode(df, block_chars=2_000)).collect()
    assert sorted((repr(r.doc_id), r.ids, bytes(r.decoded).decode()) for r in got) == sorted(
        (repr(i), vocabulary.encoding().encode_ordinary(t or ""), t or "") for i, t in rows
    )


def test_forward_sums_all_segmentations():
    counts = pd.DataFrame(
        {"y": "x", "piece": ["▁", "a", "b", "ab", "▁a"], "n": [4, 3, 2, 5, 1]}
    )
    model = language._model(counts)
    p = dict(zip(model.numbers, model.probabilities[:, 0], strict=False))
    want = p["▁"] * (p["a"] * p["b"] + p["ab"]) + p["▁a"] * p["b"]
    assert np.exp(language.word_scores(model, ["ab"])[0, 0]) == pytest.approx(want)


def test_language_held_out_accuracy(spark):
    got = language.op8_language(spark, SMALL).toPandas()
    truth = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang").toPandas()
    both = got[got["held_out"]].merge(truth, on="doc_id")
    assert (both["lang_pred"] == both["lang"]).mean() > 0.9 and got["score"].between(0, 1).all()


def test_language_of_awkward_rows(spark, awkward):
    rows, df = awkward
    model = language.fit(spark.createDataFrame([(1, "der die das", "de")], SCHEMA + ", lang string"))
    got = language.predict(df, model).collect()
    assert len(got) == len(rows) and {r.lang_pred for r in got} == {"de", "und"}
    nothing = language.fit(spark.createDataFrame([], SCHEMA + ", lang string"))
    assert {r.lang_pred for r in language.predict(df, nothing).collect()} == {"und"}


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers(spark, awkward, module, label):
    docs = spark.read.parquet(f"/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", label)
    model = module.fit(docs, labels, F.col("doc_id") % 4 != 0)
    got = module.score(docs.where("doc_id % 4 = 0"), model).join(labels, "doc_id").toPandas()
    assert (got["predicted"] == got[label]).mean() > 0.9
    rows, df = awkward
    assert module.score(df, model).where("score BETWEEN 0 AND 1").count() == len(rows)
    assert module.score(df, module.fit(docs, labels.limit(0), F.lit(True))).count() == len(rows)


def test_empty_tables(spark):
    none = empty(spark)
    for made in (minhash.deduplicate(none), suffix.repeats(none), packing.pack(none), bpe.encode(none)):
        assert made.count() == 0
