"""Removal of lines that repeat across documents, by range-partitioned line hashes and keep bitmaps."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, chunks, durable, frugal

LINE = "high long, low long, doc_id long, text_hash long, position int, n_lines int"
DROPPED = "doc_id long, text_hash long, position int, n_lines int"


def line_key(line: bytes) -> bytes:
    return line.strip().lower()  # of bytes: ASCII white space and ASCII letters only


def text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _document(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), text_hash().alias("text_hash"))


def hashed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """128-bit hashes of the keys of all lines long enough; a null doc_id is set to NULL_ID."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            high, low, ids, hashes, positions, counts = [], [], [], [], [], []
            for doc_id, text, own in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                lines = text.split(b"\n")
                for position, line in enumerate(lines):
                    key = line_key(line)
                    if len(key) >= min_chars and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars):
                        digest = xxhash.xxh3_128_digest(key)
                        high.append(int.from_bytes(digest[:8], "big", signed=True))
                        low.append(int.from_bytes(digest[8:], "big", signed=True))
                        ids.append(NULL_ID if doc_id is None else doc_id)
                        hashes.append(own)
                        positions.append(position)
                        counts.append(len(lines))
            yield pa.RecordBatch.from_arrays([pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(positions, pa.int32()), pa.array(counts, pa.int32())], names=["high", "low", "doc_id", "text_hash", "position", "n_lines"])

    return _document(docs).mapInArrow(frugal(run), LINE)


def _numbers(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {name: batch.column(name).to_numpy() for name in batch.schema.names}


def _runs(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Where each run of equal hashes begins."""
    return np.concatenate(([0], np.flatnonzero((np.diff(high) != 0) | (np.diff(low) != 0)) + 1)) if len(high) else np.zeros(0, np.int64)


def _documents_in(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Distinct ids in each run; ids ascend within a run."""
    new = np.concatenate(([True], np.diff(ids) != 0))
    new[starts] = True
    return np.add.reduceat(new.astype(np.int64), starts)


def whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Sorted rows, regrouped so that no run of one hash is cut, except at the partition's ends."""
    held: list[dict[str, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = _numbers(batch)
        starts = _runs(rows["high"], rows["low"])
        same = bool(held) and held[0]["high"][0] == rows["high"][0] and held[0]["low"][0] == rows["low"][0]
        if len(starts) == 1 and (same or not held):
            held.append(rows)
            continue
        ready = held + [{k: v[: starts[-1]] for k, v in rows.items()}]
        out = {k: np.concatenate([r[k] for r in ready]) for k in rows}
        if len(out["high"]):
            yield out
        held = [{k: v[starts[-1] :] for k, v in rows.items()}]
    if held:
        yield {k: np.concatenate([r[k] for r in held]) for k in held[0]}


def dropped_lines(docs: DataFrame, min_docs: int, min_chars: int, keep_first: bool) -> DataFrame:
    """Positions of the lines to drop.

    Hashes are range-partitioned and sorted by document and position, so equal lines stream past in order. The
    document is part of the range key: a line that fills a third of the table is split over many partitions. The
    first and last hash of each partition, two rows each, are then the only ones that can be cut; their document
    counts are added up on the driver.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = durable(hashed_lines(docs, min_chars))
    ordered = durable(lines.repartitionByRange(n, "high", "low", "doc_id").sortWithinPartitions("high", "low", "doc_id", "position"))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for rows in whole_runs(batches):
            starts = _runs(rows["high"], rows["low"])
            counts = _documents_in(rows["doc_id"], starts)
            runs = [(int(rows["high"][s]), int(rows["low"][s]), int(rows["doc_id"][s]), int(c)) for s, c in ((starts[0], counts[0]), (starts[-1], counts[-1]))]
            first, last = first or runs[0], runs[1]
        found = [] if first is None else [first] if first[:2] == last[:2] else [first, last]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(4)], names=["high", "low", "doc_id", "documents"])

    totals: dict[tuple[int, int], int] = {}
    begins: dict[tuple[int, int], int] = {}
    for high, low, doc_id, documents in ordered.select("high", "low", "doc_id").mapInArrow(frugal(ends), "high long, low long, doc_id long, documents long").collect():
        totals[high, low] = totals.get((high, low), 0) + documents
        begins[high, low] = min(begins.get((high, low), doc_id), doc_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_runs(batches):
            starts = _runs(rows["high"], rows["low"])
            counts = _documents_in(rows["doc_id"], starts)
            for i in (0, -1):
                key = int(rows["high"][starts[i]]), int(rows["low"][starts[i]])
                counts[i] = max(counts[i], totals.get(key, 0))
            lengths = np.diff(np.concatenate((starts, [len(rows["high"])])))
            drop = np.repeat(counts >= min_docs, lengths)
            if keep_first:
                for s, length in zip(starts.tolist(), lengths.tolist()):
                    key = int(rows["high"][s]), int(rows["low"][s])
                    if drop[s] and begins.get(key, rows["doc_id"][s]) == rows["doc_id"][s]:
                        # Rows that repeat doc_id and text share a bitmap, so the line stays in all of them.
                        own = slice(s, s + length)
                        drop[own] = ~np.logical_and.reduce([rows[c][own] == rows[c][s] for c in ("doc_id", "text_hash", "position")])
            columns = {k: v[drop] for k, v in rows.items()}
            yield pa.RecordBatch.from_arrays([pa.array(columns[c]) for c in ("doc_id", "text_hash", "position", "n_lines")], names=["doc_id", "text_hash", "position", "n_lines"])

    return ordered.mapInArrow(frugal(run), DROPPED)


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """Per document that loses a line: doc_id, text_hash, n_lines and `keep`, a compressed bitmap of its lines.

    A line's key is the line without white space at either end, in lower case (A-Z). Lines whose keys, of
    `min_chars` code points or more, are found in `min_docs` documents or more are dropped; with `keep_first`,
    the key's first occurrence by doc_id and position stays. Documents are told apart by doc_id, and a null
    doc_id is one document. Rows that repeat doc_id and text get one bitmap; a null or empty text is one empty
    line, which has no key. Other columns are ignored. An empty table gives no bitmap.
    """
    dropped = dropped_lines(docs, min_docs, min_chars, keep_first)
    per_document = dropped.groupBy("doc_id", "text_hash").agg(F.max("n_lines").alias("n_lines"), F.collect_set("position").alias("positions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bitmaps = []
            for n, positions in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                keep = np.ones(n, bool)
                keep[positions] = False
                bitmaps.append(zlib.compress(np.packbits(keep).tobytes(), 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(bitmaps, pa.binary())], names=["doc_id", "text_hash", "n_lines", "keep"])

    bitmaps = per_document.mapInArrow(frugal(run), "doc_id long, text_hash long, n_lines int, keep binary")
    return bitmaps.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))


def kept_lines(text: bytes, keep: bytes | None) -> tuple[bytes, int, int]:
    """The text under a bitmap, its number of lines, and how many were dropped."""
    lines = text.split(b"\n")
    if keep is None:
        return text, len(lines), 0
    stay = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines)).astype(bool)
    return b"\n".join(line for line, ok in zip(lines, stay.tolist()) if ok), len(lines), int((~stay).sum())


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """`docs` beside their bitmap `__keep`, null where all lines stay."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    left = docs.select(*names, F.col("doc_id").cast("long").alias("__doc_id"), text_hash().alias("__text_hash"))
    right = bitmaps.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("keep").alias("__keep"))
    return left.join(right, F.col("__doc_id").eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__hash")), "left").select(*names, "__keep")


def kept_digests(docs: DataFrame, **rules) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped and the sha256 of what stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            kept = [kept_lines(t, k) for t, k in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([k[1] for k in kept], pa.int64()), pa.array([k[2] for k in kept], pa.int64()), pa.array([hashlib.sha256(k[0]).hexdigest() for k in kept], pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return with_bitmaps(_document(docs).drop("text_hash"), keep_bitmaps(docs, **rules)).mapInArrow(frugal(run), "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def without_repeated_lines(docs: DataFrame, **rules) -> DataFrame:
    """`docs` with repeated lines taken out of text and n_chars set anew; a document left without a word is dropped
    if it had one. Columns other than text and n_chars pass unchanged."""
    names, types = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            texts, stay = [], []
            for text, keep in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("__keep").to_pylist()):
                kept = text if text is None else kept_lines(text, keep)[0]
                stay.append(keep is None or bool(kept.split()))
                texts.append(kept)
            columns = [pa.array(texts, pa.binary()).cast(pa.string()) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(stay, pa.bool_()))

    out = with_bitmaps(docs, keep_bitmaps(docs, **rules)).mapInArrow(frugal(run), types)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in names else out
