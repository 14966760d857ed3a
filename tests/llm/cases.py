"""Small tables of awkward rows, and brute-force helpers."""

import re
import zlib

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Columns whose names an operator might use inside.
CLASHING = ["size", "taken", "n_words", "text_hash", "keep", "class", "n", "row", "host", "__kept", "version", "gram", "word", "count"]


def words(text):
    return WORD.findall(text or "")


def sentence(i, n=40):
    return " ".join(f"w{(i * 7919 + k * k * 31 + k) % 997}x{k % 13}" for k in range(n))


def rows():
    base = sentence(1, 120)
    near = base.split()
    near[60] = "changed"
    out = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n ", "en", None, 4), (4, "One", "en", "a", 3), (5, "one", "fr", "b", 3),
        (6, base, "en", "a", len(base)), (7, base, "en", "b", len(base)), (8, " ".join(near), "en", "a", 0), (9, base.upper(), "en", None, 0),
        (10, "Copyright  line\nunique ten\n  COPYRIGHT  LINE \n", "de", "c", 0), (11, "x" * 70_000, "en", "c", 70_000), (12, "dup dup dup dup dup " * 50, "en", "c", 0),
        (13, "日本語 テキスト、é à ü\n\n😀 end", "ja", "b", 0), (14, "12345 678", "en", "b", 0),
    ]
    out += [(20 + i, f"shared boiler plate\nown {sentence(i, 15)}\n<s>[INST] & </s> {i}", ["en", "fr"][i % 2], f"s{i % 3}", 0) for i in range(14)]
    out += [(-5, "negative id with a few words here now", "en", "a", 0), (60, "many words " + sentence(99, 3000), "en", "a", 0)]
    return out


def documents(spark, extra=False, table=None):
    df = spark.createDataFrame(rows() if table is None else table, DOCS).repartition(3)
    if extra:
        df = df.selectExpr("*", *(f"'z' AS `{c}`" for c in CLASHING))
    return df


def fold(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus
