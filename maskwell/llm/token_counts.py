"""Unigram token counts by dynamic programming over a trie of pre-tokens."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, words_of
from .packing import tokenizer_path

#: A pre-token starts with this mark, as the pieces of words do.
MARK = "▁"
#: A character that no piece covers is spelled by bytes: each byte is a token of this score.
BYTE_SCORE = -1e6
#: Trie nodes that a worker remembers, about; a longer pre-token than LONG characters leaves none.
KNOWN_NODES, LONG = 1_000_000, 4096
#: Words whose terminals a worker remembers, about, and their bytes.
KNOWN_WORDS, KNOWN_BYTES = 300_000, 32 << 20


class Vocabulary:
    """Pieces and scores of a sentencepiece model, without control, unknown and byte pieces."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.scores = {model.id_to_piece(i): float(model.get_score(i)) for i in ids}
        self.longest = max(map(len, self.scores), default=1)


class Trie:
    """Pre-tokens by their characters. A node has its prefix's best score and the fewest tokens that reach it.

    The best segmentation of a prefix does not depend on what follows, so each node is scored once, when the first
    pre-token that passes it is inserted, from the scores of the nodes above it. Where a pre-token ends, its terminal
    stores the score and the number of tokens; terminals are numbered as they are inserted.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.terminal_scores, self.terminal_counts = array("d"), array("l")
        self.prune()

    def prune(self) -> None:
        """Forget the nodes, not the terminals."""
        #: The node below another by a character: keys are the node's number times 2**21 plus the code point.
        self.below: dict[int, int] = {}
        self.score, self.count = array("d", [0.0]), array("l", [0])

    def extended(self, token: str, end: int, scores: list[float], counts: list[int]) -> tuple[float, int]:
        """Score and tokens of the best segmentation of the first `end` characters, from those of all shorter prefixes."""
        size = len(token[end - 1].encode("utf-8", "surrogatepass"))
        best, fewest = scores[end - 1] + size * BYTE_SCORE, counts[end - 1] + size
        for start in range(max(0, end - self.vocabulary.longest), end):
            piece = self.vocabulary.scores.get(token[start:end])
            if piece is not None:
                piece += scores[start]
                if piece > best or (piece == best and counts[start] + 1 < fewest):
                    best, fewest = piece, counts[start] + 1
        return best, fewest

    def insert(self, token: str) -> int:
        """The number of the token's terminal. Of segmentations of equal score the one of fewest tokens counts."""
        if len(self.score) > KNOWN_NODES:
            self.prune()
        scores, counts, node, kept = [0.0], [0], 0, len(token) <= LONG
        for end, char in enumerate(token, 1):
            key = (node << 21) + ord(char)
            known = self.below.get(key) if kept else None
            if known is None:
                best, fewest = self.extended(token, end, scores, counts)
                if kept:
                    node = self.below[key] = len(self.score)
                    self.score.append(best)
                    self.count.append(fewest)
            else:
                node, best, fewest = known, self.score[known], self.count[known]
            scores.append(best)
            counts.append(fewest)
        self.terminal_scores.append(scores[-1])
        self.terminal_counts.append(counts[-1])
        return len(self.terminal_counts) - 1


class WordCosts:
    """Terminals of words, remembered between batches of a worker. Word number i of `words` has terminal i."""

    def __init__(self, path: str):
        self.trie = Trie(Vocabulary(path))
        self.forget()

    def forget(self) -> None:
        self.trie.clear()
        self.words = pa.array([], pa.binary())

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Scores and token counts of the words, read from their terminals."""
        if len(self.words) > KNOWN_WORDS or self.words.nbytes > KNOWN_BYTES:
            self.forget()
        found = pc.index_in(words, value_set=self.words)
        if found.null_count:
            new = pc.unique(words.filter(pc.is_null(found)))
            for word in new.to_pylist():
                self.trie.insert(MARK + word.decode("utf-8", "replace"))
            self.words = pa.concat_arrays([self.words, new])
            found = pc.index_in(words, value_set=self.words)
        codes = found.to_numpy()
        return np.array(self.trie.terminal_scores)[codes], np.array(self.trie.terminal_counts)[codes]


_costs: dict[str, WordCosts] = {}


def word_costs(path: str) -> WordCosts:
    if path not in _costs:
        _costs[path] = WordCosts(path)
    return _costs[path]


def token_counts(docs: DataFrame, tokenizer: str = "piece_bpe_32k.model") -> DataFrame:
    """Per row of `docs`: doc_id, n_pretokens, n_tokens and score, under a unigram model over the tokenizer's pieces.

    A pre-token is a word with a mark before it. Its segmentation is the one whose pieces' scores, those of the
    model file, have the highest sum; of equal sums, the one of fewest tokens. A document's values are sums over its
    words (null or empty text: 0). Other columns are ignored, rows that repeat get equal rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs = word_costs(tokenizer_path(tokenizer))
        for batch in chunks(batches):
            words, per_doc = words_of(batch.column("text"))
            scores, counts = costs.of(words)
            ends = np.cumsum(per_doc)
            total = lambda v: np.diff(np.concatenate(([0], np.cumsum(v)))[np.concatenate(([0], ends))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(per_doc.astype(np.int64)), pa.array(total(counts)), pa.array(total(scores))], names=["doc_id", "n_pretokens", "n_tokens", "score"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long, score double")
