"""Mixing of sources to target weights, by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, WORD, chunks, durable, frugal

#: Words in a block.
BLOCK = 64
#: Words in a shard, about, and the number of shards that the driver apportions at most (a larger table gets larger shards).
SHARD_WORDS = 65_536
MOST_SHARDS = 65_536


def targets(sizes: Sequence[int], weights: Sequence[float], share: float, limit: float) -> list[float]:
    """Each source's words: shares of `share` times all words by weight, none above `limit` times its size.

    What a source cannot take goes to the others by weight, again and again until no source is above its limit.
    """
    out, open_, left = [0.0] * len(sizes), list(range(len(sizes))), share * sum(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        above = [i for i in open_ if left * weights[i] / total > limit * sizes[i]]
        if not above:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in above:
            out[i] = limit * sizes[i]
            left -= out[i]
        left = max(0.0, left)
        open_ = [i for i in open_ if i not in set(above)]
    return out


def apportion(votes: Sequence[float], seats: int, most: Sequence[int]) -> list[int]:
    """Sainte-Laguë: each seat in turn goes to the highest quotient votes / (2 * seats held + 1).

    Nobody gets more than `most`. Equal quotients: the earlier one first. The seats that are certain, one below
    each lower quota, are given at once; the rest one by one.
    """
    n, total = len(votes), float(sum(votes))
    seats = min(seats, sum(most))
    if seats <= 0 or total <= 0:
        return [0] * n
    held = [min(m, max(0, int(v * seats / total) - 1)) for v, m in zip(votes, most)]
    if sum(held) > seats:
        held = [0] * n
    heap = [(-v / (2 * h + 1), i) for i, (v, h, m) in enumerate(zip(votes, held, most)) if h < m and v > 0]
    heapq.heapify(heap)
    for _ in range(seats - sum(held)):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        held[i] += 1
        if held[i] < most[i]:
            heapq.heappush(heap, (-votes[i] / (2 * held[i] + 1), i))
    return held


def word_count(column: str = "text"):
    return F.coalesce(F.regexp_count(F.col(column).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


PLAN = "doc_id long, source string, text_hash long, nth int, size long, source_size long, target double, taken long, passes int, spans array<int>"


def mix_plan(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, limit: float = 2.0, block: int = BLOCK, seed: int = 20, shard_words: int = SHARD_WORDS) -> DataFrame:
    """What the mix takes of each document: one row per row of `docs`.

    `docs` has doc_id, source and text; other columns are ignored. The size is the number of words (null: 0).
    Sources sort by code point, null last, and take the weights in turn. Documents are dealt to shards of their
    source by a hash; within a shard their words, by doc_id, form blocks of about `block` words. Sainte-Laguë
    gives each source, then each of its shards, whole blocks. A shard takes all its blocks as often as its
    quota allows (`passes`) and the rest in a row from a seeded start, so few documents are cut: `spans` has
    from and to, in words, for each part taken beyond the passes. Rows that repeat are documents of their own
    (`nth` tells equal rows apart). An empty table gives no rows; sources without words take nothing.
    The driver holds a row per source and per shard, MOST_SHARDS and one per source at most.
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), word_count().alias("size"))
    equal = Window.partitionBy("doc_id", "text_hash").orderBy("source", "size")
    sized = durable(sized.withColumn("nth", F.row_number().over(equal)))
    found = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("documents")).collect()
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in found]
    aims = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], share, limit)
    words_in_shard = max(shard_words, sum(sizes) // MOST_SHARDS + 1)
    counts = [max(1, -(-s // words_in_shard)) for s in sizes]
    spark = docs.sparkSession
    known = spark.createDataFrame([(r["source"], n) for r, n in zip(found, counts)], "named string, n_shards long")
    dealt = sized.join(known, sized["source"].eqNullSafe(known["named"])).drop("named")
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text_hash", "nth"), F.col("n_shards"))).drop("n_shards")
    shards: dict[str | None, list[tuple[int, int]]] = {}
    for r in dealt.groupBy("source", "shard").agg(F.sum("size").alias("size")).collect():
        shards.setdefault(r["source"], []).append((r["shard"], r["size"]))
    blocks, votes = [], []
    for r, aim in zip(found, aims):
        own = sorted(shards[r["source"]])
        own = [(shard, size, max(1, round(size / block)) if size else 0) for shard, size in own]
        blocks.append(own)
        votes.append(aim / r["size"] * sum(b for *_, b in own) if r["size"] else 0.0)
    passes = int(np.ceil(limit))
    quotas = apportion(votes, round(sum(votes)), [int(limit * sum(b for *_, b in own)) for own in blocks])
    plan: dict[tuple[str | None, int], tuple[int, int, int, float]] = {}
    for r, own, quota, aim in zip(found, blocks, quotas, aims):
        for (shard, _, n), q in zip(own, apportion([b for *_, b in own], quota, [passes * b for *_, b in own])):
            plan[r["source"], shard] = n, q, r["size"], aim

    def run(key: tuple, table: pa.Table) -> pa.Table:
        source, shard = key[0].as_py(), key[1].as_py()
        n_blocks, quota, source_size, aim = plan[source, shard]
        table = table.sort_by([("doc_id", "ascending"), ("text_hash", "ascending"), ("nth", "ascending")])
        sizes = table.column("size").to_numpy()
        ends = np.cumsum(sizes)
        begins, total = ends - sizes, int(sizes.sum())
        whole, rest = divmod(quota, n_blocks) if n_blocks else (0, 0)
        edge = lambda i: i * total // n_blocks
        parts = []
        if rest:
            start = xxhash.xxh64_intdigest(f"{seed}/{source}/{shard}") % n_blocks
            parts = [(edge(start), edge(min(n_blocks, start + rest)))]
            if start + rest > n_blocks:
                parts.append((0, edge(start + rest - n_blocks)))
        taken, spans = whole * sizes, [[] for _ in sizes]
        for low, high in parts:
            a, b = np.maximum(begins, low), np.minimum(ends, high)
            taken = taken + np.maximum(0, b - a)
            for i in np.flatnonzero(b > a).tolist():
                spans[i] += [int(a[i] - begins[i]), int(b[i] - begins[i])]
        n = len(sizes)
        columns = [*(table.column(c).combine_chunks() for c in ("doc_id", "source", "text_hash", "nth", "size")), pa.array([source_size] * n, pa.int64()), pa.array([aim] * n, pa.float64()), pa.array(taken, pa.int64()), pa.array([whole] * n, pa.int32()), pa.array(spans, pa.list_(pa.int32()))]
        return pa.table(columns, names=["doc_id", "source", "text_hash", "nth", "size", "source_size", "target", "taken", "passes", "spans"])

    return dealt.groupBy("source", "shard").applyInArrow(run, PLAN)


def word_span(text: bytes, start: int, stop: int) -> bytes:
    """The text from its word number `start` up to the end of the word before number `stop`."""
    at, seen, begin, end = 0, 0, 0, len(text)
    for word in text.split():
        at = text.index(word, at)
        if seen == start:
            begin = at
        at += len(word)
        seen += 1
        if seen == stop:
            end = at
            break
    return text[begin:end]


def mix(docs: DataFrame, **rules) -> DataFrame:
    """The mixed documents: a row for each whole pass over a document and for each part taken beyond.

    Columns are those of `docs`; text is the part taken and n_chars, if there, its code points. Documents that
    the mix does not take are absent.
    """
    names = docs.columns
    plan = mix_plan(docs, **rules).where("taken > 0").select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("__id"), F.col("text_hash").alias("__hash"), F.col("nth").alias("__nth"), F.col("passes").alias("__passes"), F.col("spans").alias("__spans"))
    equal = Window.partitionBy("__own_id", "__own_hash").orderBy("__own_source")
    own = docs.withColumns({"__own_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), "__own_hash": F.xxhash64(F.col("text").cast("string")), "__own_source": F.col("source").cast("string")})
    own = own.withColumn("__own_nth", F.row_number().over(equal))
    joined = own.join(plan, (F.col("__own_id") == F.col("__id")) & (F.col("__own_hash") == F.col("__hash")) & (F.col("__own_nth") == F.col("__nth")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            rows, texts = [], []
            data = batch.column("text").cast(pa.binary()).to_pylist()
            for i, (text, passes, spans) in enumerate(zip(data, batch.column("__passes").to_pylist(), batch.column("__spans").to_pylist())):
                parts = [text] * passes + [word_span(text, a, b) for a, b in zip(spans[::2], spans[1::2])]
                rows += [i] * len(parts)
                texts += parts
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()).cast(pa.string()) if c == "text" else taken.column(c) for c in names], names=names)

    out = joined.select(*names, "__passes", "__spans").mapInArrow(frugal(run), docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in names else out
