"""Quality rules and the frequency of lines across a host's documents, in Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, durable

#: All white space that separates words, for translate().
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: A line is frequent on a host when more distinct documents hold it than both limits.
MAX_DOCS, MAX_SHARE = 50, 0.1
#: A document is depleted when fewer words stay than both of these.
MIN_WORDS, MIN_STAY = 10, 0.2
#: Rows of a rejection list that may be broadcast.
BROADCAST_ROWS = 1_000_000


def _text(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _host(column: str = "source") -> Column:
    """The source; a null one is a host of its own."""
    return F.coalesce(F.concat(F.lit("s"), F.col(column).cast("string")), F.lit("n"))


def with_measures(docs: DataFrame) -> DataFrame:
    """Each row of `docs` as a struct `row`, beside n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and
    base_failed. In the struct, columns of any name are out of the way.

    A word in a repeated window is counted once, however many such windows cover it: the starts of repeated
    windows are sorted, and each adds the words up to the next start, WINDOW at most.
    """
    docs = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    own = [F.col("row")]
    text = _text("row.text")
    filled = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    out = docs.select(*own, F.filter(F.split(text, SPACE + "+"), lambda w: w != "").alias("_words"), filled.alias("_lines"))
    bare = F.translate(text, BLANKS, "")
    out = out.select(
        *own,
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(bare).cast("long").alias("word_chars"),
        (F.char_length(bare) - F.char_length(F.translate(bare, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    counts = [F.col(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines")]
    window = F.transform(F.sequence(F.lit(0), F.size("_hashes") - WINDOW), lambda i: F.xxhash64(*(F.get("_hashes", i + k) for k in range(WINDOW))))
    none = F.array().cast("array<bigint>")
    out = out.select(*own, *counts, F.when(F.size("_hashes") >= WINDOW, window).otherwise(none).alias("_windows"))
    twice = F.size(F.array_distinct("_windows")) < F.size("_windows")
    out = out.select(*own, *counts, F.when(twice, F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_sorted"))
    same = lambda k, x: F.coalesce(F.get("_sorted", k)["h"] == x["h"], F.lit(False))
    starts = F.array_sort(F.transform(F.filter("_sorted", lambda x, k: same(k - 1, x) | same(k + 1, x)), lambda x: x["i"]))
    out = out.select(*own, *counts, starts.alias("_starts"))
    covered = F.transform("_starts", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_starts", k + 1) - p, F.lit(WINDOW))))
    repeated = F.coalesce(F.aggregate(covered, F.lit(0), lambda a, b: a + b), F.lit(0)).cast("long")
    out = out.select(*own, *counts, repeated.alias("n_repeat_words"))
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.lower(F.trim(line, F.lit(BLANKS))))


def host_lines(docs: DataFrame) -> DataFrame:
    """A row for every line with a word: its document, host, normalised hash and number of words."""
    key = [F.col("doc_id").cast("long").alias("doc_id"), _host().alias("host"), F.xxhash64(_text()).alias("text_hash")]
    lines = docs.select(*key, F.explode(F.split(_text(), "\n")).alias("line")).where(F.col("line").rlike(WORD))
    words = F.regexp_count("line", F.lit(WORD)).cast("long")
    return lines.select("doc_id", "host", "text_hash", line_hash(F.col("line")).alias("line_hash"), words.alias("words"))


def frequent_lines(docs: DataFrame, max_docs: int, max_share: float) -> DataFrame:
    """Lines above the limits on their host, and the smallest doc_id that holds them.

    Documents are told apart by their text, so exact copies count once. Counting distinct texts aggregates by
    host, line and text before it aggregates by host and line, so no task sees all rows of a common line.
    """
    lines = host_lines(docs)
    counted = lines.groupBy("host", "line_hash").agg(F.countDistinct("text_hash").alias("n_docs"), F.min("doc_id").alias("first_doc")).where(F.col("n_docs") > max_docs)
    hosts = docs.select(_host().alias("host"), F.xxhash64(_text()).alias("text_hash")).groupBy("host").agg(F.countDistinct("text_hash").alias("host_docs"))
    return counted.join(hosts, "host").where(F.col("n_docs") > max_share * F.col("host_docs")).select("host", "line_hash", "n_docs", "first_doc")


def lost_lines(docs: DataFrame, max_docs: int, max_share: float) -> DataFrame:
    """The rows of host_lines() that their documents lose. The document that holds a line first keeps it."""
    frequent = frequent_lines(docs, max_docs, max_share)
    return host_lines(docs).join(frequent, ["host", "line_hash"]).where(~F.col("doc_id").eqNullSafe(F.col("first_doc")))


def removed_words(docs: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """Per document with frequent lines: doc_id, host, text_hash and the words in those lines."""
    lines = lost_lines(docs, max_docs, max_share)
    return lines.groupBy("doc_id", "host", "text_hash").agg(F.sum("words").alias("removed_words"), F.count("*").alias("removed_lines"))


def text_without(text: Column, hashes: Column) -> Column:
    """The text without its lines of these hashes; lines without a word stay."""
    stay = lambda line: ~line.rlike(WORD) | ~F.array_contains(hashes, line_hash(line))
    return F.array_join(F.filter(F.split(text, "\n"), stay), "\n")


def depleted(n_words: Column, removed: Column, min_words: int = MIN_WORDS, min_stay: float = MIN_STAY) -> Column:
    stay = n_words - removed
    return (removed > 0) & (stay < min_words) & (stay < min_stay * n_words)


def quality(docs: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """One row per row of `docs` (doc_id, text, source): the measures, base_failed, removed_words and kept.

    A document is kept unless base_failed or depleted by the removal of its host's frequent lines. A null text has
    no words; a null source is a host of its own; rows that repeat get equal rows. Extra columns are ignored.
    """
    plain = docs.select("doc_id", "text", "source")
    measured = with_measures(plain)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    measured = measured.select(F.col("row.doc_id").cast("long").alias("doc_id"), _host("row.source").alias("host"), F.xxhash64(_text("row.text")).alias("text_hash"), *names)
    removed = removed_words(plain, max_docs, max_share).select(F.col("doc_id").alias("_id"), F.col("host").alias("_host"), F.col("text_hash").alias("_hash"), "removed_words")
    same = measured["doc_id"].eqNullSafe(removed["_id"]) & (measured["host"] == removed["_host"]) & (measured["text_hash"] == removed["_hash"])
    out = measured.join(removed, same, "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
    kept = ~F.col("base_failed") & ~depleted(F.col("n_words"), F.col("removed_words"))
    return out.select("doc_id", *names, kept.alias("kept"), "removed_words")


def kept_documents(docs: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """The rows of `docs` that quality() keeps, with the columns of `docs`: the host's frequent lines taken out of text
    (but for the document that holds a line first) and n_chars set anew."""
    lines = lost_lines(docs.select("doc_id", "text", "source"), max_docs, max_share)
    lost = durable(lines.groupBy("doc_id", "host", "text_hash").agg(F.sum("words").alias("removed_words"), F.collect_set("line_hash").alias("hashes")))
    small = lost.agg(F.coalesce(F.sum(F.size("hashes")), F.lit(0))).first()[0] <= BROADCAST_ROWS
    # The number keeps the filter above the measures: pushed below them, it would repeat them inside their own lambdas.
    measured = with_measures(docs).withColumn("number", F.monotonically_increasing_id())
    measured = measured.where(~F.col("base_failed") & (F.col("number") >= 0)).select("row", "n_words")
    same = F.col("row.doc_id").cast("long").eqNullSafe(F.col("doc_id")) & (_host("row.source") == F.col("host")) & (F.xxhash64(_text("row.text")) == F.col("text_hash"))
    out = measured.join(F.broadcast(lost) if small else lost, same, "left")
    out = out.where(F.col("hashes").isNull() | ~depleted(F.col("n_words"), F.col("removed_words")))
    text = F.when(F.col("hashes").isNull(), F.col("row.text")).otherwise(text_without(_text("row.text"), F.col("hashes")))
    out = out.select(F.col("row").withField("text", text).alias("row"))
    if "n_chars" in docs.columns:
        out = out.select(F.col("row").withField("n_chars", F.char_length("row.text").cast("long")).alias("row"))
    return out.select("row.*")
