"""Ranked lexical search, a term at a time, with a limited set of accumulators.

A forward index holds, per document, its length and the counts of the terms that some query has.
The terms of a query are taken rarest first. An accumulator is a query and a document with the sum
so far. Blocks of terms open new accumulators until what the remaining terms can add at most stays
below the sum that is now in the last place asked for: a document without an accumulator then can
no longer reach it. Accumulators that cannot reach it either are dropped, and the survivors get
their remaining terms from the forward index, exactly.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import store, table

COUNT = 50  # documents per query
SLICE_TERMS = 500_000  # terms of the queries answered at a time, about
FIRST_POSTINGS = 2_000  # postings that the first block of a query's terms is meant to have
GROWTH = 4  # times the postings in each further block
TEXTS_AT_A_TIME = 256

# Letters and digits stay, A-Z become lower case, everything else separates; UTF-8 beyond ASCII stays.
_FOLD = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)


def terms_of(data: bytes | None) -> list[bytes]:
    """All terms of a text in UTF-8, with repeats."""
    return (data or b"").translate(_FOLD).split()


def _slices(batches):
    """Arrow batches of at most ``TEXTS_AT_A_TIME`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS_AT_A_TIME):
            yield batch.slice(at, TEXTS_AT_A_TIME)


def _item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term), each once; rows of one item_id are one query."""

    def run(batches):
        for batch in _slices(batches):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            found = [sorted({*terms_of(text)}) for text in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id"), pa.array(found, pa.list_(pa.binary())).cast(pa.list_(pa.string()))],
                ["item_id", "terms"],
            )

    kind = dict(items.dtypes)["item_id"]
    listed = items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, terms array<string>")
    return listed.select("item_id", F.explode("terms").alias("term")).distinct()


def forward_index(documents: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """(row, doc_id, n, found) of every row: its length in terms, and (term, tf) of the terms numbered.

    ``numbers`` is a part of the queries' terms, of bounded size; texts are read whole.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(numbers)

    def run(batches):
        known = shared.value
        pair = pa.struct([("term", pa.int32()), ("tf", pa.int64())])
        for batch in _slices(batches):
            lengths, found = [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                words = terms_of(text)
                lengths.append(len(words))
                counts = Counter(words)
                found.append([{"term": known[w], "tf": counts[w]} for w in counts.keys() & known.keys()])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    batch.column("doc_id"),
                    pa.array(lengths, pa.int64()),
                    pa.array(found, pa.list_(pair)),
                ],
                ["row", "doc_id", "n", "found"],
            )

    rows = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    kind = dict(documents.dtypes)["doc_id"]
    return rows.mapInArrow(
        run, f"row long, doc_id {kind}, n long, found array<struct<term: int, tf: long>>"
    )


def search(documents: DataFrame, items: DataFrame, count: int = COUNT) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``count`` best documents with a score above 0.

    Null and empty texts have no terms. Rows that repeat a doc_id are documents of their own, and
    a null doc_id comes first among equal scores; rows of one item_id are one query, null included.
    Items without terms, or without documents that hold one, are not in the result. Further columns
    are left out. Queries are answered in slices of about SLICE_TERMS terms, a slice at a time.
    """
    asked = store(_item_terms(items), "query-terms")
    parts = 1 + asked.count() // SLICE_TERMS
    found = []
    for part in range(parts):
        own = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part) if parts > 1 else asked
        found.append(_searched(documents, own, count))
    return reduce(DataFrame.unionByName, found)


class Plan:
    """The terms of a slice of queries, rarest first, in blocks that grow.

    Everything here has as many rows as the slice has terms, so the driver and each task hold it.
    Items and terms go by number. ``rest[item][block]`` bounds what the terms after a block can
    still add to any document.
    """

    def __init__(self, asked: list[tuple[int, int]], stats: dict[int, tuple[int, int]], docs: int):
        terms: dict[int, list[tuple[int, int]]] = {}
        for item, term in asked:
            if term in stats:  # else no document holds it
                terms.setdefault(item, []).append((self._weight(stats[term][0], docs), term))
        self.blocks: dict[int, list[list[tuple[int, int]]]] = {}  # item: blocks of (term, weight)
        self.rest: dict[int, list[int]] = {}
        for item, weighted in terms.items():
            weighted.sort(key=lambda pair: (-pair[0], pair[1]))
            left = sum(w * stats[t][1] for w, t in weighted)
            blocks: list[list[tuple[int, int]]] = []
            rest: list[int] = []
            postings, room = 0, 0
            for weight, term in weighted:
                if not blocks or postings >= room:
                    room = FIRST_POSTINGS if not blocks else room * GROWTH
                    blocks.append([])
                    rest.append(left)
                blocks[-1].append((term, weight))
                postings += stats[term][0]
                left -= weight * stats[term][1]
                rest[-1] = left
            self.blocks[item], self.rest[item] = blocks, rest

    @staticmethod
    def _weight(df: int, docs: int) -> int:
        return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))

    def block(self, items, number: int) -> list[tuple[int, int, int]]:
        """(item, term, weight) of the items' terms in one block."""
        return [
            (item, term, weight)
            for item in items
            if number < len(self.blocks[item])
            for term, weight in self.blocks[item][number]
        ]


def _searched(documents: DataFrame, asked: DataFrame, count: int) -> DataFrame:
    spark = documents.sparkSession
    rows = [(r.item_id, r.term) for r in asked.collect()]  # one slice
    names = list(dict.fromkeys(item for item, _ in rows))
    terms = {t: k for k, t in enumerate(sorted({t for _, t in rows}))}
    number = {item: k for k, item in enumerate(names)}
    index = store(forward_index(documents, {t.encode(): k for t, k in terms.items()}), "forward")
    sizes = index.where("n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    norm = F.expr(
        f"CAST(50 + (CAST(50 * n AS DECIMAL(38, 0)) * {sizes.docs}L) div {sizes.terms or 1}L AS BIGINT)"
    )
    held = index.select("row", norm.alias("m"), F.explode("found").alias("p")).select(
        "row", "p.term", F.expr("(1000000000L * p.tf) div (1000 * p.tf + 20 * m)").alias("gain")
    )
    stats = held.groupBy("term").agg(F.count("*").alias("df"), F.max("gain").alias("most")).collect()
    plan = Plan([(number[i], terms[t]) for i, t in rows], {r.term: (r.df, r.most) for r in stats}, sizes.docs)
    kept = _accumulated(spark, plan, held, count)
    kinds = [dict(df.dtypes)[c] for df, c in ((asked, "item_id"), (documents, "doc_id"))]
    if kept is None:
        return spark.createDataFrame([], f"item_id {kinds[0]}, rank int, doc_id {kinds[1]}, score long")
    due = kept.groupBy("row").agg(F.collect_list(F.struct("item", "block", "score")).alias("due"))
    scored = _completed(index.select("row", "doc_id", norm.alias("m"), "found").join(due, "row"), plan, kinds[1])
    rank = F.row_number().over(
        Window.partitionBy("item").orderBy(F.desc("score"), F.asc("doc_id"), F.asc("row"))
    )
    named = spark.createDataFrame([(k, item) for k, item in enumerate(names)], f"item int, item_id {kinds[0]}")
    return (
        scored.where("score > 0").withColumn("rank", rank).where(F.col("rank") <= count)
        .join(F.broadcast(named), "item")  # no more rows than the slice has terms
        .select("item_id", "rank", "doc_id", "score")
    )


def _accumulated(spark: SparkSession, plan: Plan, held: DataFrame, count: int) -> DataFrame | None:
    """(item, row, score, block): accumulators that can still reach an item's last place.

    ``score`` sums the terms up to and with that block. Null if no document holds any term.
    """
    partial, survivors, waiting, block = None, [], sorted(plan.blocks), 0
    while waiting:
        now = spark.createDataFrame(plan.block(waiting, block), "item int, term int, weight long")
        added = held.join(F.broadcast(now), "term").select(
            "item", "row", (F.col("weight") * F.col("gain")).alias("score")
        )
        every = added if partial is None else partial.unionByName(added)
        every = store(every.groupBy("item", "row").agg(F.sum("score").alias("score")), "partial")
        # The sum in the last place asked for, of the items that have so many accumulators.
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))
        last = every.withColumn("place", place).where(F.col("place") <= count)
        last = last.groupBy("item").agg(F.min("score").alias("bar"), F.count("*").alias("n"))
        bars = {r.item: r.bar for r in last.collect() if r.n >= count}
        state = [
            (item, bars.get(item, 0), plan.rest[item][min(block, len(plan.rest[item]) - 1)]) for item in waiting
        ]
        # New documents cannot reach the last place, or all terms are done: no more accumulators.
        ended = {item for item, bar, rest in state if rest < bar or block + 1 >= len(plan.blocks[item])}
        known = spark.createDataFrame(
            [(item, bar - rest, item in ended) for item, bar, rest in state], "item int, least long, ended boolean"
        )
        reaching = every.join(F.broadcast(known), "item").where(F.col("score") >= F.col("least"))
        survivors.append(
            reaching.where("ended").select("item", "row", "score", F.lit(block).alias("block"))
        )
        partial = reaching.where("NOT ended").select("item", "row", "score")
        waiting = [item for item in waiting if item not in ended]
        block += 1
    return store(reduce(DataFrame.unionByName, survivors), "survivors") if survivors else None


def _completed(rows: DataFrame, plan: Plan, kind: str) -> DataFrame:
    """(item, row, doc_id, score): the accumulators of each document with all their terms."""
    shared = rows.sparkSession.sparkContext.broadcast(plan)

    def run(batches):
        blocks = shared.value.blocks
        later: dict[tuple[int, int], dict[int, int]] = {}
        for batch in _slices(batches):
            out = []
            columns = (batch.column(c).to_pylist() for c in ("m", "found", "due"))
            for at, (m, found, due) in enumerate(zip(*columns, strict=True)):
                gains = {
                    p["term"]: 1_000_000_000 * p["tf"] // (1000 * p["tf"] + 20 * m) for p in found
                }
                for d in due:
                    key = d["item"], d["block"]
                    if key not in later:
                        later[key] = dict(t for some in blocks[key[0]][key[1] + 1 :] for t in some)
                    more = later[key]
                    added = sum(more[t] * gains[t] for t in more.keys() & gains.keys())
                    out.append((at, d["item"], d["score"] + added))
            at, items, scores = zip(*out, strict=True) if out else ((), (), ())
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(items, pa.int32()),
                    batch.column("row").take(take),
                    batch.column("doc_id").take(take),
                    pa.array(scores, pa.int64()),
                ],
                ["item", "row", "doc_id", "score"],
            )

    return rows.mapInArrow(run, f"item int, row long, doc_id {kind}, score long")


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that rank highest for each benchmark item."""
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    return search(documents, table(spark, sf_dir, "benchmark", "item_id", "text"))
