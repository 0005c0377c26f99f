"""Pages, vectors, links and the pipeline against spelled-out definitions."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from riskweave.llm import ann, common, embedding_dedup, extraction, graph

SMALL = "/root/testdata/sf0.001"

PAGE = """<html><body class="has-sidebar"><header class="site-header"><h1>Site</h1></header>
<div class="cookie-notice">We use</div><main><article><header><h1>Title &amp; x</h1>
<div class="byline">by me</div></header><p>One two<br>three, <a href=x>link</a> and&nbsp;so on.
<ul><li>a<li>b</ul><script>if (a<b) "</p>"</script><form>no</form>
<section id="comments"><p>bad</p></section></article><aside>no</aside></main><footer>f</footer>"""


def test_extraction(spark):
    rows = [(1, "http://h/x", PAGE), (1, "http://h/x", PAGE), (2, None, None), (3, "http://h/y", "")]
    rows += [(None, "http://h/z", "<p>plain"), (4, "x", "<b>" * 3000 + "deep"), (5, "http://h", "a < b")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(0))
    got = sorted((r.page_id or 0, r.text) for r in extraction.extract(df).collect())
    text = "Title & x\n\nOne two three, link and so on.\n\na\n\nb"
    assert got == [(0, "plain"), (1, text), (1, text), (2, ""), (3, ""), (4, "deep"), (5, "a < b")]
    assert extraction.extract(df.limit(0)).count() == 0


def test_host_decides_where_a_page_alone_would_err(spark):
    usual = "<body><div class=x><p>{}</p></div><div class=y><p>{}</p></div></body>"
    rows = [(k, "http://h/1", usual.format("main text " * 20, "aside")) for k in range(5)]
    rows.append((9, "http://h/2", usual.format("short", "a long list of other things " * 5)))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert extraction.extract(df).where("page_id = 9").first().text == "short"


def test_components(spark):
    links = [(1, 2), (3, 2), (5, 4), (9, 5), (7, 7), (None, 3)] + [(k, k + 1) for k in range(20, 60)]
    got = dict(graph.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 9: 4, **{k: 20 for k in range(20, 61)}}


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((400, 16))
    near = base[:60] + 0.05 * rng.standard_normal((60, 16))
    x = np.vstack([base, near, base[:5], base[:5] * 4.0]).astype("float32").astype(float)
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    bad = [(1000, None), (1001, [0.0] * 16), (1002, [math.nan] * 16), (1003, [None] * 16), (1004, [math.inf] * 16)]
    rows_all = rows + bad + [(None, rows[0][1]), rows[3], (1005, [1.0, 2.0])]
    df = spark.createDataFrame(rows_all, "vec_id long, embedding array<float>").withColumn("list", F.lit(1))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    return rows_all, df, unit @ unit.T


def test_vector_links(vectors):
    rows, df, cosine = vectors
    linked = cosine >= 0.9
    np.fill_diagonal(linked, False)
    got = embedding_dedup.deduplicate(df).collect()
    assert len(got) == len(rows)
    lowest = np.arange(len(linked))
    for _ in range(20):
        lowest = np.minimum(lowest, np.where(linked, lowest[None, :], 10**6).min(axis=1))
    for r in got:
        if r.vec_id is None:
            assert r.component_id is None and not r.kept and r.n_links == 0
        elif r.vec_id < 1000:
            assert (r.n_links, r.component_id) == (linked[r.vec_id].sum(), lowest[r.vec_id])
        else:
            assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True)


def test_search_recall_and_form(vectors):
    _, df, cosine = vectors
    got = ann.nearest(df, F.col("vec_id") % 10 == 0).toPandas()
    scores = cosine.copy()
    np.fill_diagonal(scores, -2)
    hits = total = 0
    for query, found in got[got["query_id"] < 1000].groupby("query_id"):
        assert found.sort_values("rank")["rank"].tolist() == [1, 2, 3, 4, 5]
        best = np.lexsort((np.arange(len(scores)), -scores[query].round(12)))[:5]
        hits += len(set(best) & set(found["vec_id"]))
        total += 5
    assert hits / total >= 0.9
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0


def test_smallest_ids_of_equal_cosines_are_found():
    rng = np.random.default_rng(7)
    x, q = rng.standard_normal(16), rng.standard_normal((70, 16))
    scaled = [x * 2.0**k for k in range(40)]
    frame = {"q_ids": [list(range(70))], "q_vectors": [list(q)], "ids": [list(range(139, 99, -1))]}
    got = pd.concat(ann._compared([pd.DataFrame(frame | {"vectors": [scaled]})], 6))
    assert len(got) == 420
    assert all(sorted(found) == list(range(100, 106)) for _, found in got.groupby("rep")["id"])


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.store(stage(spark, docs, SMALL), name)
        assert kept.dtypes == docs.dtypes and 0 < kept.count() <= docs.count()
        docs = kept
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_sample_is_the_first_ids_by_hash(spark):
    rows = [(k, f"text {k}") for k in range(5000)] + [(7, "text")] * 3 + [(8, "x" * 99), (8, None), (None, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("y", F.lit("clash"))
    labels = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("bad"))
    got = sorted(common.labelled_sample(docs, labels, "bad", F.lit(True), 100, 50).collect())
    text = {k: f"text {k}" for k in range(5000)} | {7: "text"}
    hashes = spark.range(5000).select("id", F.xxhash64("id").alias("h")).orderBy("h").collect()
    wanted = [[r.id for r in hashes if r.id % 2 == y][:100] for y in (0, 1)]
    assert got == sorted((text[k], y) for y in (0, 1) for k in wanted[y])
    assert common.labelled_sample(docs, labels.limit(0), "bad", F.lit(True), 100, 50).count() == 0
