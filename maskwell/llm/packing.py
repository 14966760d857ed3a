"""Packing of tokenised documents into training windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, durable, frugal, words_of

#: Pieces that are packed together: bounds one group's work and makes groups independent of each other.
GROUP_PIECES = 1024
#: Longest remainder left whole; longer ones are halved, since near-equal windows need small pieces.
LONGEST_REST = 2048
END_ID = 2
#: Words whose ids one worker remembers, and bytes of text that it encodes at a time: they bound its memory, beside which the JVM's is large.
KNOWN_WORDS, ENCODED_BYTES = 200_000, 1 << 20

# The rules of a tokenizer file under which lower-cased runs of letters are pre-tokens of their own.
LOWERED = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")


def splits_at_space(tokenizer) -> bool:
    """Whether texts with all kinds of white space have the ids of their words in a row."""
    words = ["One", "two's", "3.4", "é,", "(x)", "日本", "don't", "-", "Ab1"]
    text = "".join(w + s for w, s in zip(words, [" ", "\n", "\t", "  ", "\r\n", " \n ", "\x0b", "\x0c", ""]))
    encode = lambda s: tokenizer.encode(s, add_special_tokens=False).ids
    return encode(text) == [i for w in words for i in encode(w)]


class WordIds:
    """Token ids of white-space separated words, remembered between batches of a worker.

    The tokenizer's pre-tokenizer never joins characters across white space, so a text's ids are those of its
    words in a row. Plain Latin words go to the BPE model without the normaliser, which would only lower them, if
    the file's rules are those expected; a file whose tokens may cross white space is refused.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        #: Whether the model may get plain words without the normaliser: only if the file's rules are those expected.
        self.plain = {k: rules.get(k) for k in LOWERED} == LOWERED
        if not self.plain and not splits_at_space(self.tokenizer):
            raise ValueError(f"{path}: its tokens may cross white space, so that texts cannot be encoded word by word")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in shown]
        self.byte_chars = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.forget()

    def forget(self, keep: np.ndarray | None = None) -> None:
        """Forget all words but those to keep."""
        if keep is None or not len(keep):
            self.words = pa.array([], pa.binary())
            self.starts, self.counts, self.again, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool), np.zeros(0, np.uint32)
            return
        counts = self.counts[keep]
        self.pool = self.pool[self.places(keep)]
        self.words, self.counts, self.again = self.words.take(pa.array(keep)), counts, np.zeros(len(keep), bool)
        self.starts = np.cumsum(counts, dtype=np.int64) - counts

    def places(self, codes: np.ndarray) -> np.ndarray:
        """Where the ids of these words are, in a row."""
        counts = self.counts[codes]
        ends = np.cumsum(counts, dtype=np.int64)
        at = np.repeat(self.starts[codes] - (ends - counts), counts)
        at += np.arange(len(at))
        return at

    def encode(self, words: list[bytes]) -> list[list[int]]:
        out: list[list[int] | None] = []
        whole, tails = [], {}
        tokenize, chars = self.tokenizer.model.tokenize, self.byte_chars
        for i, raw in enumerate(words):
            found = PLAIN.fullmatch(raw.decode("utf-8", "replace")) if self.plain else None
            if not found:
                whole.append(i)
                out.append(None)
                continue
            letters, tail = found.groups()
            letters = letters.lower()
            if not letters.isascii():
                letters = "".join(chars[b] for b in letters.encode())
            ids = [t.id for t in tokenize(letters)]
            if tail:
                if tail not in tails:
                    tails[tail] = self.tokenizer.encode(tail, add_special_tokens=False).ids
                ids += tails[tail]
            out.append(ids)
        for i, e in zip(whole, self.tokenizer.encode_batch_fast([words[i].decode("utf-8", "replace") for i in whole], add_special_tokens=False)):
            out[i] = e.ids
        return out

    def ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and each word's number of ids."""
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        table = words.dictionary_encode()
        found = pc.index_in(table.dictionary, value_set=self.words)
        self.again[found.drop_null().to_numpy()] = True
        if found.null_count:
            new = table.dictionary.filter(pc.is_null(found))
            if len(self.words) + len(new) > KNOWN_WORDS:
                # Words met again stay, if they leave room; a call's own words are always taken in.
                keep = np.flatnonzero(self.again)
                self.forget(keep if len(keep) + len(new) <= KNOWN_WORDS else None)
                found = pc.index_in(table.dictionary, value_set=self.words)
                new = table.dictionary.filter(pc.is_null(found))
            got = self.encode(new.to_pylist())
            counts = np.fromiter(map(len, got), np.int32, len(got))
            pool = np.fromiter((t for ids in got for t in ids), np.uint32, int(counts.sum()))
            del got
            self.starts = np.concatenate((self.starts, len(self.pool) + np.cumsum(counts, dtype=np.int64) - counts))
            self.counts, self.pool = np.concatenate((self.counts, counts)), np.concatenate((self.pool, pool))
            self.again = np.concatenate((self.again, np.zeros(len(new), bool)))
            # The new words are the last ones, in their order.
            codes = pc.fill_null(found, 0).to_numpy().copy()
            codes[pc.is_null(found).to_numpy(zero_copy_only=False)] = np.arange(len(self.words), len(self.words) + len(new))
            self.words = pa.concat_arrays([self.words, new])
        else:
            codes = found.to_numpy()
        codes = codes[table.indices.to_numpy()]
        return self.pool[self.places(codes)], self.counts[codes]


_tokenizers: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _tokenizers:
        # A worker has one core's work; a pool of threads would only hold memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _tokenizers[path] = WordIds(path)
    return _tokenizers[path]


def tokenizer_path(name_or_path: str) -> str:
    if "/" in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


def cut(n: int, window: int) -> list[int]:
    """Piece lengths of a document of n tokens: full windows, then a rest, in two parts if it is long."""
    rest = n % window
    lengths = [window] * (n // window)
    if rest > min(LONGEST_REST, window // 2):
        lengths += [(rest + 1) // 2, rest // 2]
    elif rest:
        lengths.append(rest)
    return lengths


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def token_pieces(docs: DataFrame, tokenizer: str, window: int) -> DataFrame:
    """One row per piece of a document, without the ids themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_ids(tokenizer_path(tokenizer))
        for batch in chunks(batches, limit=ENCODED_BYTES):
            words, per_doc = words_of(batch.column("text"))
            ids, per_word = coder.ids(words)
            ends = np.concatenate(([0], np.cumsum(per_word)))[np.cumsum(per_doc)]
            rows, begin = [], 0
            for doc_id, end in zip(batch.column("doc_id").to_pylist(), ends.tolist()):
                own = np.append(ids[begin:end], np.uint32(END_ID)).astype("<u4")
                data, at, begin = memoryview(own.tobytes()), 0, end
                for n in cut(len(own), window):
                    rows.append((doc_id, at, n, zlib.crc32(data[4 * at : 4 * (at + n)]), len(own)))
                    at += n
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(frugal(run), PIECE)


def difference(lengths: list[int], k: int) -> np.ndarray:
    """Each item's part, 0 to k-1, by the Karmarkar-Karp largest differencing method for k parts.

    Every item starts as a partial partition with all its weight in one part. The two partitions whose parts
    differ most are merged, the fullest parts of one with the emptiest of the other, until one is left.
    """
    n = len(lengths)
    if k <= 1 or n <= 1:
        return np.zeros(n, np.int64)
    # A partition: sums in ascending order. Its tree remembers where the parts of both sides went.
    trees: list[int | tuple] = list(range(n))
    sums: dict[int, np.ndarray] = {}
    heap = []
    for i, length in enumerate(lengths):
        s = np.zeros(k, np.int64)
        s[-1] = length
        sums[i] = s
        heap.append((-length, i))
    heapq.heapify(heap)
    made = n
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        merged = sums.pop(a) + sums.pop(b)[::-1]
        order = np.argsort(merged, kind="stable")
        sums[made] = merged[order]
        place = np.empty(k, np.int64)
        place[order] = np.arange(k)
        trees.append((a, b, place))
        heapq.heappush(heap, (-int(sums[made][-1] - sums[made][0]), made))
        made += 1
    part = np.empty(n, np.int64)
    stack = [(made - 1, np.arange(k))]
    while stack:
        node, to = stack.pop()
        tree = trees[node]
        if isinstance(tree, int):
            part[tree] = to[-1]
        else:
            a, b, place = tree
            here = to[place]
            stack += [(a, here), (b, here[::-1])]
    return part


def windows(lengths: list[int], window: int) -> np.ndarray:
    """Each piece's window. Starts from the fewest windows that could hold all; each time a window would
    overflow, their number rises. A piece of a full window has one to itself."""
    lengths = np.asarray(lengths, np.int64)
    out = np.empty(len(lengths), np.int64)
    full = lengths >= window
    out[full] = np.arange(full.sum())
    rest = lengths[~full]
    if len(rest):
        k = int(-(-rest.sum() // window))
        while True:
            part = difference(rest.tolist(), k)
            if np.bincount(part, rest, k).max() <= window:
                break
            k += max(1, k // 500)
        out[~full] = part + full.sum()
    return out


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", window: int = 4096) -> DataFrame:
    """Pack documents into windows of at most `window` tokens; one row per piece.

    `docs` has doc_id and text; other columns are ignored whatever their names. A null or empty text is the end
    id alone. Rows that repeat a doc_id are documents of their own. An empty table gives no rows. A document of
    any length is cut into full windows, which stand alone, and a rest that is packed with others.
    Groups of about GROUP_PIECES pieces are dealt by a hash of the piece and packed independently, so no task
    sees more than its groups, and a sequence_id is the group's number times 2**20 plus the window's.
    """
    pieces = durable(token_pieces(docs, tokenizer, window))
    groups = max(1, -(-pieces.count() // GROUP_PIECES))
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        lengths = table.column("length").to_numpy()
        part = windows(lengths, window)
        order = np.argsort(part, kind="stable")
        ends = np.cumsum(lengths[order])
        first = np.concatenate(([True], np.diff(part[order]) > 0))
        begin = (ends - lengths[order])[first]
        offset = ends - lengths[order] - begin[np.cumsum(first) - 1]
        table = table.take(pa.array(order))
        number = (key[0].as_py() << 20) + part[order]
        return pa.table([*(table.column(c).combine_chunks() for c in schema.names[:5]), pa.array(number), pa.array(offset)], schema=schema)

    dealt = pieces.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)))
    return dealt.groupBy("pack_group").applyInArrow(run, PIECE + ", sequence_id long, offset long")
