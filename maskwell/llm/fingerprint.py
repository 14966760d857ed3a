"""Homomorphic multiset fingerprints of documents, in Spark expressions only.

A text's units are its paragraphs (lines) and their phrases, cut after words that end in about half of all characters, so that an edit moves
few cuts. Each unit is hashed to a wide vector and the vectors are summed, lane by lane, modulo a power of two:

* DIGESTS lanes of 32 bits, modulo 2**32, from each paragraph: equality whatever the order of paragraphs;
* LANES lanes of one bit, modulo 2**16, from each phrase: with the number of phrases, lane sums give the
  cosine of two multisets.

Sums add and subtract, so paragraphs can be put in or taken out without the rest of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, durable, written

#: Three lanes of 21 bits are summed in one long.
FIELD, PER_LONG = 21, 3
MASK = sum(1 << (FIELD * i) for i in range(PER_LONG))
LANES, DIGESTS = 126, 8
LANE_BITS, DIGEST_BITS = 16, 32
#: Characters after which phrases are summed in one more block, so that no field of 21 bits overflows.
BLOCK_CHARS = 1 << 20
PHRASE_END = r"(?<=[acegikmoqsuwyACEGIKMOQSUWY02468.,;:!?#$%&*<>|)\]]|[^\x00-\x7F])[\x20\x09\x0B-\x0D]+"


def units(versions: DataFrame, keys: list[str], text: str) -> DataFrame:
    """A row per phrase: keys, block, the paragraph's digest lanes (on its first phrase) and the phrase's hashes.

    A lane's number is hashed before the unit, as a seed: two units that agree in one lane still differ in the others."""
    n_blocks = F.floor(F.col("_chars") / BLOCK_CHARS) + 1
    rows = versions.select(*keys, F.char_length(text).alias("_chars"), F.posexplode(F.split(text, "\n")).alias("_p", "_paragraph"))
    digests = [F.xxhash64(F.lit(i), "_paragraph").alias(f"_d{i}") for i in range(DIGESTS // 2)]
    rows = rows.select(*keys, "_chars", "_p", *digests, F.posexplode(F.split("_paragraph", PHRASE_END)).alias("_q", "_phrase"))
    block = F.pmod(F.col("_p") * 31 + F.col("_q"), n_blocks.cast("int"))
    return rows.select(*keys, block.alias("_block"), (F.col("_q") == 0).alias("_first"), *(f"_d{i}" for i in range(DIGESTS // 2)), F.xxhash64(F.lit(0), "_phrase").alias("_h0"), F.xxhash64(F.lit(1), "_phrase").alias("_h1"))


def summed(versions: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Per key: n (phrases), digests and lanes, both arrays of longs."""
    rows = units(versions, keys, text)
    fields = [F.shiftrightunsigned(F.col(f"_h{j}"), s).bitwiseAND(F.lit(MASK)) for j in range(2) for s in range(FIELD)]
    halves = [h for i in range(DIGESTS // 2) for h in (F.col(f"_d{i}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(F.col(f"_d{i}"), 32))]
    sums = [F.sum(f).alias(f"_s{i}") for i, f in enumerate(fields)]
    digests = [F.sum(F.when(F.col("_first"), h).otherwise(F.lit(0))).alias(f"_e{i}") for i, h in enumerate(halves)]
    blocks = rows.groupBy(*keys, "_block").agg(F.count("*").alias("_n"), *sums, *digests)
    low = (1 << FIELD) - 1
    lanes = F.array(*(F.shiftrightunsigned(F.col(f"_s{i}"), FIELD * k).bitwiseAND(F.lit(low)) for i in range(2 * FIELD) for k in range(PER_LONG)))
    packed = blocks.select(*keys, "_block", F.struct(F.col("_n").alias("n"), F.array(*(F.col(f"_e{i}").bitwiseAND(F.lit(0xFFFFFFFF)) for i in range(DIGESTS))).alias("digests"), lanes.alias("lanes")).alias("_f"))
    gathered = packed.groupBy(*keys).agg(F.collect_list("_f").alias("_fs"))
    first = F.get("_fs", F.lit(0))
    total = F.aggregate(F.slice("_fs", F.lit(2), F.size("_fs")), first, lambda a, b: plus(a, b))
    return gathered.select(*keys, reduced(total).alias("fp"))


def _mod(values: Column, bits: int) -> Column:
    return F.transform(values, lambda v: v.bitwiseAND(F.lit((1 << bits) - 1)))


def reduced(fp: Column) -> Column:
    return F.struct(fp["n"].alias("n"), _mod(fp["digests"], DIGEST_BITS).alias("digests"), _mod(fp["lanes"], LANE_BITS).alias("lanes"))


def plus(a: Column, b: Column) -> Column:
    """The fingerprint of both multisets together, not yet reduced."""
    return F.struct((a["n"] + b["n"]).alias("n"), F.zip_with(a["digests"], b["digests"], lambda x, y: x + y).alias("digests"), F.zip_with(a["lanes"], b["lanes"], lambda x, y: x + y).alias("lanes"))


def insert(a: Column, b: Column) -> Column:
    """The fingerprint after paragraphs with fingerprint b are put in."""
    return reduced(plus(a, b))


def delete(a: Column, b: Column) -> Column:
    """The fingerprint after paragraphs with fingerprint b are taken out."""
    return reduced(F.struct((a["n"] - b["n"]).alias("n"), F.zip_with(a["digests"], b["digests"], lambda x, y: x - y).alias("digests"), F.zip_with(a["lanes"], b["lanes"], lambda x, y: x - y).alias("lanes")))


def as_text(fp: Column) -> Column:
    digits = lambda values, n: F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v), n, "0")), "")
    return F.lower(F.concat(F.lpad(F.hex(fp["n"]), 16, "0"), digits(fp["digests"], DIGEST_BITS // 4), digits(fp["lanes"], LANE_BITS // 4)))


def _signed(fp: Column) -> Column:
    """Lanes about their mean: ones less zeros in each. The lane's sum is the one nearest half of n."""
    half, size = F.floor(fp["n"] / 2), 1 << LANE_BITS
    return F.transform(fp["lanes"], lambda v: 2 * (F.pmod(v - half + size // 2, F.lit(size)) - size // 2) - fp["n"] % 2)


def packed(fp: Column) -> Column:
    """A fingerprint in the fewest bytes that Spark's rows allow, for shuffles and tables: 16-bit lanes, 32-bit digests."""
    fit = lambda values, bits, kind: F.transform(values, lambda v: (v - F.lit(1 << (bits - 1))).cast(kind))
    return F.struct(fp["n"].alias("n"), fit(fp["digests"], DIGEST_BITS, "int").alias("digests"), fit(fp["lanes"], LANE_BITS, "smallint").alias("lanes"))


def unpacked(fp: Column) -> Column:
    """The fingerprint that packed() was given."""
    back = lambda values, bits: F.transform(values, lambda v: v.cast("long") + F.lit(1 << (bits - 1)))
    return F.struct(fp["n"].alias("n"), back(fp["digests"], DIGEST_BITS).alias("digests"), back(fp["lanes"], LANE_BITS).alias("lanes"))


def signed(fp: Column) -> Column:
    """A fingerprint's centred lanes and their squared length, for likeness()."""
    lanes = _signed(fp)
    norm = F.aggregate(lanes, F.lit(0.0), lambda x, y: x + (y * y).cast("double"))
    return F.struct(lanes.alias("lanes"), norm.alias("norm"), fp["digests"].alias("digests"))


def likeness(a: Column, b: Column) -> Column:
    """Estimated cosine of two multisets of phrases given as signed(), 0 to 1; 1 for equal fingerprints."""
    dot = F.aggregate(F.zip_with(a["lanes"], b["lanes"], lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y.cast("double"))
    cosine = F.coalesce(F.try_divide(dot, F.sqrt(a["norm"] * b["norm"])), F.lit(0.0))
    return F.when((a["digests"] == b["digests"]) & (a["lanes"] == b["lanes"]), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per distinct doc_id and text of `docs`: doc_id and fp (n, digests, lanes)."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("text_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "text_hash"])
    return summed(base, ["doc_id", "text_hash"], "text").drop("text_hash")


def successors(ids: DataFrame) -> DataFrame:
    """Each (doc_id, text_hash)'s successor in ascending order, `next_id` and `next_hash`; the last one's is the first.

    Ids are range-partitioned and sorted; lead() runs within each partition, and the partitions' first rows, one
    each, close the gaps between them.
    """
    n = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = durable(ids.repartitionByRange(n, "doc_id", "text_hash").withColumn("part", F.spark_partition_id()))
    firsts = {r["part"]: r["first"] for r in ordered.groupBy("part").agg(F.min(F.struct("doc_id", "text_hash")).alias("first")).collect()}
    parts = sorted(firsts)
    after = {p: firsts[parts[(i + 1) % len(parts)]] for i, p in enumerate(parts)}
    heads = F.array(*(F.lit(after[p][c] if p in after else None).cast("long") for c in ("doc_id", "text_hash") for p in range(max(parts, default=0) + 1)))
    size = max(parts, default=0) + 1
    ordered = ordered.withColumn("heads", heads)
    row = Window.partitionBy("part").orderBy("doc_id", "text_hash")
    return ordered.select(
        "doc_id", "text_hash", "n_chars",
        F.coalesce(F.lead("doc_id").over(row), F.get("heads", F.col("part"))).alias("next_id"),
        F.coalesce(F.lead("text_hash").over(row), F.get("heads", F.col("part") + size)).alias("next_hash"),
    )


def edit_report(docs: DataFrame, tail: int = 4) -> DataFrame:
    """Fingerprints of every text and of an edited one, whose last 1/tail of code points is replaced by the first as
    many (or all) of the next document by doc_id; how like the text's is to the edited text's and the next one's.

    A null text is empty; a null doc_id comes first. Documents of one doc_id follow each other by a hash of their
    text, and rows that repeat both give one row. A single document is its own successor. An empty table gives no
    rows; other columns are ignored.
    """
    key = ["doc_id", "text_hash"]
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("text_hash", F.xxhash64("text"))
    links = durable(successors(base.groupBy(*key).agg(F.max(F.char_length("text")).cast("long").alias("n_chars"))))
    last = F.floor(F.col("n_chars") / tail).cast("int")
    heads = base.join(links.select(F.col("next_id").alias("doc_id"), F.col("next_hash").alias("text_hash"), F.col("doc_id").alias("to_id"), F.col("text_hash").alias("to_hash"), last.alias("last")), key)
    heads = heads.select(F.col("to_id").alias("doc_id"), F.col("to_hash").alias("text_hash"), F.left("text", F.col("last")).alias("head"))
    both = base.join(links.select(*key, "n_chars", "next_id", "next_hash"), key).join(heads, key).dropDuplicates(key)
    edited = F.concat(F.left("text", F.col("n_chars").cast("int") - last), F.col("head"))
    # The successor's key goes with the row to the last join, so that fingerprints are dealt out once only.
    row = [*key, "n_chars", "next_id", "next_hash"]
    versions = both.select(*row, "text", edited.alias("edited"))
    versions = versions.select(*row, F.unhex(F.sha2("edited", 256)).alias("edited_sha256"), F.posexplode(F.array("text", "edited")).alias("version", "body"))
    own = [*row, "edited_sha256"]
    pairs = summed(versions, [*own, "version"], "body").groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("version", "fp"))).alias("v"))
    pairs = written(pairs.select(*own, packed(F.get("v", F.lit(0))["fp"]).alias("fp"), packed(F.get("v", F.lit(1))["fp"]).alias("edited_fp")))
    theirs = pairs.select(F.col("doc_id").alias("next_id"), F.col("text_hash").alias("next_hash"), F.col("fp").alias("next_fp"))
    out = pairs.join(theirs, ["next_id", "next_hash"])
    out = out.withColumns({c: unpacked(F.col(c)) for c in ("fp", "edited_fp", "next_fp")})
    out = out.select("*", signed(F.col("fp")).alias("a"), signed(F.col("edited_fp")).alias("b"), signed(F.col("next_fp")).alias("c"))
    return out.select(
        F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"),
        "n_chars",
        F.lower(F.hex("edited_sha256")).alias("edited_sha256"),
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"),
        likeness(F.col("a"), F.col("c")).alias("near_next"),
    )
