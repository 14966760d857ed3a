"""Language-model scores from online logistic mixing of hashed-context bit predictors over running text.

A text is its words, A-Z lower-cased, and an end. The common words, the end and an escape have a binary code (Huffman's,
by training counts), and each bit of it is predicted along the text by several predictors: how often either bit followed
at this node of the code (order 0), after the word before, and after the two words before, in all training text; and how
often it did so far in this document, alone and after the word before. The last four look up hashed tables. Their
stretched probabilities are combined by weights that a gate, how much the contexts of two words and of one were seen,
selects; a refinement table corrects the outcome. Weights and refinement start from those fitted to the training
documents and follow each document online, a block of words after the other, as the document's own counts do.

After an escape the word itself is spelled: a mixture, normalised over all words, of its discounted training count among
such words and its probability byte by byte. That spelling is another mixer of the same kind, whose contexts are the last
bytes of the word, trained on the vocabulary.

The three loops over running text, which count, fit and score, run in the JVM (`kernel`). Their numpy versions here say what
they do, and do it where Spark has no compiler.

Scores do not depend on partitioning but for the averaging of fitted weights over training tasks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.java_gateway import JavaObject
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel
from .common import chunks, frugal, hashed_to, words_of, written

#: Bytes of context of each predictor, and the slots of its table (log2).
ORDERS, TABLE_BITS = (1, 2, 3, 4, 6), 18
#: Steps by which a gate tells how often the longest context was seen.
SEEN, BINS = 4, 24
#: Common words, at most, which are broadcast, and their bytes; others are escaped, and their counts joined.
HEAD, HEAD_BYTES = 150_000, 256
#: Words that a training task learns from, about, and symbols that go through the mixer together.
TASK_WORDS, STEP = 300_000, 2048
FLAT = 1 << 15
#: Slots of a table of word contexts (log2), and of a document's own tables, at most (log2).
CONTEXT_BITS, OWN_BITS = 20, 16
#: Words of a document between two updates, at first and after so many words; and bits of training text.
BLOCK, LONG_BLOCK, LONG_AFTER, FIT_BITS = 32, 256, 512, 16_384
#: Bytes of text that are coded at once, words, about, of texts that are mixed side by side, and that are counted at once.
CHUNK, ABREAST, COUNTED = 2 << 20, 80_000, 1 << 16
#: Words of a block that go through the mixer together, about: what they need stays in the processor's cache.
SLICE = 2048
#: Tokens of training text, about, for which a task sends one table of counts.
TABLE_TOKENS = 10_000_000
#: Predictors, weight sets and rate of the mixer over running text.
INPUTS, GATES, RATE = 5, SEEN * SEEN, 0.02
#: Spreads the hash of a context and a node over its table.
SPREAD = np.uint64(0xD6E8FEB86659FD93)
#: Numbers of a table of word contexts that are sent as one piece.
CUT = 1 << 12


def look(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """table[at] of places that are all in the table: wrapping is the mode that numpy does fastest."""
    return table.take(at, mode="wrap")


def added_up(at: np.ndarray, values: np.ndarray | float, size: int) -> np.ndarray:
    """As bincount, in single precision: several times as fast."""
    out = np.zeros(size, np.float32)
    np.add.at(out, at, values if isinstance(values, np.ndarray) else np.float32(values))
    return out


@dataclass
class Speller:
    """Bit predictors and mixer. counts: (orders, slots, 2)."""

    counts: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.full((8 * SEEN, len(ORDERS)), 0.3, np.float64))
    refined: np.ndarray = field(default_factory=lambda: np.tile(1 / (1 + np.exp(-np.linspace(-8, 8, BINS))), (8, 1)))
    tables: list[np.ndarray] | None = None
    seen_less: list[np.ndarray] | None = None

    def left_out(self) -> list[np.ndarray]:
        """The tables as learning reads them: `counts` must not change any more."""
        if self.seen_less is None:
            self.seen_less = [less_packed(t) for t in self.counts]
        return self.seen_less

    def packed(self) -> list[np.ndarray]:
        """The tables as scoring reads them."""
        if self.tables is None:
            self.tables = [packed(t) for t in self.counts]
        return self.tables


def spelled(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All symbols (bytes and a closing zero), the contexts of each order, and where each word ends."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    symbols = np.frombuffer(b"\0".join(words) + b"\0", np.uint8).astype(np.uint64)
    ends = np.cumsum(lengths)
    place = np.arange(len(symbols)) - np.repeat(ends - lengths, lengths)
    contexts = np.empty((len(ORDERS), len(symbols)), np.uint64)
    hashed, row = np.zeros(len(symbols), np.uint64), 0
    for back in range(1, max(ORDERS) + 1):
        before = np.zeros(len(symbols), np.uint64)
        before[back:] = symbols[:-back] + np.uint64(1)
        before[place < back] = 0
        hashed = (hashed + before + np.uint64(back)) * np.uint64(0x9E3779B97F4A7C15)
        hashed ^= hashed >> np.uint64(31)
        if back in ORDERS:
            contexts[row] = hashed
            row += 1
    return symbols, contexts, ends


def slots(context: np.ndarray, node: np.ndarray) -> np.ndarray:
    return (((context + node) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def bit_at(symbols: np.ndarray, place: int) -> tuple[np.ndarray, np.ndarray]:
    """The bit at this place of each symbol, and the node of the bits before it."""
    return ((symbols >> np.uint64(7 - place)) & np.uint64(1)).astype(np.int64), (symbols >> np.uint64(8 - place)) | np.uint64(1 << place)


def inputs(tables: list[np.ndarray], contexts: np.ndarray, node: np.ndarray, bit: np.ndarray | None, place: int) -> tuple[np.ndarray, np.ndarray]:
    """Stretched predictions of all orders, a row for each, and the gate. With `bit`, the tables leave out one sight of it."""
    x, gate = np.empty((len(ORDERS), len(node)), np.float32), None
    for i, table in enumerate(tables):
        at = slots(contexts[i], node)
        entry = look(table, at if bit is None else 2 * at + bit)
        x[i] = unpacked(entry)
        gate = entry & 3
    return x, place * SEEN + gate.astype(np.int64)


def refine(model: Speller, z: np.ndarray, place: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The mixer's probability, and that of the refinement table between its two nearest bins."""
    z = np.minimum(np.maximum(z, np.float32(-7.99)), np.float32(7.99))
    spot = (z + 8) * np.float32((BINS - 1) / 16)
    floor = np.floor(spot)
    low, part = floor.astype(np.int64), spot - floor
    table = model.refined[place].astype(np.float32)
    return 1 / (1 + np.exp(-z)), look(table, low) * (1 - part) + look(table, low + 1) * part, low, part


def weighed(model: Speller, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
    return sum(x[i] * look(np.ascontiguousarray(model.weights[:, i], np.float32), gate) for i in range(len(ORDERS)))


def learn(model: Speller, words: list[bytes], rate: float = 0.02) -> None:
    """One online pass over the words: the mixer's weights and the refinement table follow each small batch."""
    tables = model.left_out()
    for at in range(0, len(words), STEP):
        symbols, contexts, _ = spelled(words[at : at + STEP])
        for place in range(8):
            bit, node = bit_at(symbols, place)
            x, gate = inputs(tables, contexts, node, bit, place)
            z = weighed(model, x, gate)
            p, _, low, part = refine(model, z, place)
            hit = bit.astype(np.float32)
            error, sets = hit - p, len(model.weights)
            scale = rate / np.sqrt(np.maximum(added_up(gate, 1, sets), 1))
            for i in range(len(ORDERS)):
                model.weights[:, i] += scale * added_up(gate, x[i] * error, sets)
            near = low + (part > 0.5)
            hits, ones = added_up(near, 1, BINS), added_up(near, hit, BINS)
            share = np.minimum(0.5, hits / (hits + 400.0))
            model.refined[place] += share * (np.divide(ones, hits, out=model.refined[place].copy(), where=hits > 0) - model.refined[place])


def log_probabilities(model: Speller, words: list[bytes]) -> np.ndarray:
    """log10 of each word's spelled probability."""
    out, at, tables = np.empty(len(words)), 0, model.packed()
    while at < len(words):
        stop, size = at, 0
        while stop < len(words) and (stop == at or size < FLAT):
            size += len(words[stop]) + 1
            stop += 1
        symbols, contexts, ends = spelled(words[at:stop])
        total = np.zeros(len(symbols))
        for place in range(8):
            bit, node = bit_at(symbols, place)
            x, gate = inputs(tables, contexts, node, None, place)
            p, q, _, _ = refine(model, weighed(model, x, gate), place)
            p = np.clip((p + q) / 2, 1e-5, 1 - 1e-5)
            total += np.log10(np.where(bit == 1, p, 1 - p))
        out[at:stop] = np.diff(np.concatenate(([0], np.cumsum(total)[ends - 1])))
        at = stop
    return out


@dataclass
class Code:
    """Binary code of common words. A word's nodes and bits are `size` entries of `nodes` and `bits` from `start` on."""

    words: list[bytes]
    start: np.ndarray
    size: np.ndarray
    nodes: np.ndarray
    bits: np.ndarray
    counts: np.ndarray
    #: Training counts of the words.
    seen: np.ndarray

    @property
    def escape(self) -> int:
        return len(self.words)


def huffman(words: list[bytes], counts: list[int], escaped: int) -> Code:
    """Huffman's code of the words and, last, the escape; `counts` per node says how often either bit is next."""
    weights = [max(1, c) for c in counts] + [max(1, escaped)]
    n = len(weights)
    heap = [(w, i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    above, side = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.uint8)
    node_counts = np.zeros((max(1, n - 1), 2), np.float32)
    for node in range(n, 2 * n - 1):
        (w0, a), (w1, b) = heapq.heappop(heap), heapq.heappop(heap)
        above[a], above[b], side[b] = node, node, 1
        node_counts[node - n] = w0, w1
        heapq.heappush(heap, (w0 + w1, node))
    root, at, levels = 2 * n - 2, np.arange(n), []
    while (at != root).any():
        inside = at != root
        levels.append((inside, above[at] - n, side[at]))
        at = np.where(inside, above[at], root)
    size = np.sum([i for i, _, _ in levels], axis=0, dtype=np.int64) if levels else np.zeros(n, np.int64)
    start = np.cumsum(size) - size
    nodes, bits = np.zeros(int(size.sum()), np.int32), np.zeros(int(size.sum()), np.uint8)
    for up, (inside, node, bit) in enumerate(levels):  # from the leaf up: the path is stored from the root down
        place = (start + size - 1 - up)[inside]
        nodes[place], bits[place] = node[inside], bit[inside]
    return Code(words, start, size, nodes, bits, node_counts, np.array(counts, np.int64))


@dataclass
class Mixer:
    """Weights per predictor and gate, and refinement per bin; counts of the two hashed word contexts: (2, slots, 2)."""

    counts: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.full((INPUTS, GATES), 0.3, np.float32))
    refined: np.ndarray = field(default_factory=lambda: (1 / (1 + np.exp(-np.linspace(-8, 8, BINS)))).astype(np.float32))
    tables: list[np.ndarray] | None = None
    #: As `tables`, for training: two entries a slot, which leave out one sight of a zero and of a one.
    seen_less: list[np.ndarray] | None = None

    def left_out(self, code: Code) -> list[np.ndarray]:
        """The tables of orders 0 to 2 as fitting reads them: `counts` must not change any more."""
        if self.seen_less is None:
            self.seen_less = [less_packed(t) for t in (code.counts, *self.counts)]
        return self.seen_less

    def packed(self, code: Code) -> list[np.ndarray]:
        """The tables of orders 0 to 2 as scoring reads them: `counts` must not change any more."""
        if self.tables is None:
            self.tables = [packed(t) for t in (code.counts, *self.counts)]
        return self.tables


def word_contexts(codes: np.ndarray, per_doc: np.ndarray) -> np.ndarray:
    """Hashes of the word before, and of the two before, of each word; at a text's start there are none."""
    place = np.arange(len(codes)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    out, hashed = np.zeros((2, len(codes)), np.uint64), np.zeros(len(codes), np.uint64)
    for back in (1, 2):
        before = np.zeros(len(codes), np.uint64)
        before[back:] = codes[:-back] + 1
        before[place < back] = 0
        hashed = (hashed + before + np.uint64(back)) * np.uint64(0x9E3779B97F4A7C15)
        hashed ^= hashed >> np.uint64(31)
        out[back - 1] = hashed
    return out


def spread_slots(context: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Slots of contexts and nodes, both multiplied by SPREAD before."""
    return ((context + node) >> np.uint64(64 - CONTEXT_BITS)).view(np.int64)


def context_slots(context: np.ndarray, node: np.ndarray) -> np.ndarray:
    return spread_slots(context * SPREAD, node.astype(np.uint64) * SPREAD)


def abreast(codes: np.ndarray, per_doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes and lengths of about ABREAST words of texts at a time, one text at least."""
    ends, low = np.cumsum(per_doc), 0
    while low < len(ends):
        done = int(ends[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(ends, done + ABREAST, "right")))
        yield codes[done : int(ends[high - 1])], per_doc[low:high]
        low = high


def bits_of(code: Code, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The word, node and bit of each choice that the words take."""
    size = look(code.size, codes)
    word = np.repeat(np.arange(len(codes)), size)
    at = np.repeat(look(code.start, codes) - (np.cumsum(size) - size), size)
    at += np.arange(len(at))
    return word, look(code.nodes, at), look(code.bits, at)


def pairs(counts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Both counts of each entry in one look-up, as a complex number's parts."""
    return counts.reshape(-1).view(np.complex64).take(at, mode="wrap")


def gate_step(sights: np.ndarray) -> np.ndarray:
    return sum((sights >= 4**step - 1).astype(np.int8) for step in range(1, SEEN)).astype(np.int64)


def packed(counts: np.ndarray) -> np.ndarray:
    """A table's stretched predictions, in steps of 1/800, and gate steps (the two lowest bits): two bytes for a slot's eight."""
    return (np.rint((stretched(counts[:, 0], counts[:, 1]) + 10) * 800).astype(np.uint16) << 2) | gate_step(counts.sum(1)).astype(np.uint16)


def less_packed(counts: np.ndarray) -> np.ndarray:
    """As packed, two entries a slot: without one sight of a zero, without one of a one."""
    return np.stack([packed(np.maximum(counts - one, 0)) for one in np.eye(2, dtype=np.float32)], 1).reshape(-1)


def unpacked(entry: np.ndarray) -> np.ndarray:
    return (entry >> 2) * np.float32(1 / 800) - np.float32(10)


def stretched(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.clip(np.log((n1 + np.float32(0.2)) / (n0 + np.float32(0.2))), -10, 10)


def blocks(model: Mixer, code: Code, codes: np.ndarray, per_doc: np.ndarray, left_out: bool) -> Iterator[tuple]:
    """Blocks of all documents side by side, the first of each, then the second..., about SLICE words at a time: (first
    document, one after the last, document, where each document's choices start, x, gate, bit), the latter three and document per choice.

    Documents come longest first, so those that still have words are the first ones; `document` is the place in that order,
    and `order` (in the first item, alone) says which that is. Counts of a document's own are those of its blocks before.
    With `left_out`, training counts leave out one sight of the choice itself."""
    order = np.argsort(-per_doc, kind="stable")
    length, begin = per_doc[order], (np.cumsum(per_doc) - per_doc)[order]
    contexts = word_contexts(codes, per_doc) * SPREAD
    bits = np.add.reduceat(np.append(code.size[codes], 0), np.cumsum(per_doc) - per_doc)[order] if len(codes) else np.zeros(0, np.int64)
    room = 1 << np.minimum(OWN_BITS, np.log2(np.maximum(bits, 2)).astype(np.int64))
    # Own counts start at the fifth that stretching adds to each.
    first, own = np.cumsum(room) - room, np.full((2, int(room.sum()), 2), 0.2, np.float32)
    tables = model.left_out(code) if left_out else model.packed(code)
    yield order
    longest = int(length[0]) if len(length) else 0
    for at in [*range(0, min(longest, LONG_AFTER), BLOCK), *range(LONG_AFTER, longest, LONG_BLOCK)]:
        most = BLOCK if at < LONG_AFTER else LONG_BLOCK
        active = int(np.searchsorted(-length, -at, "left"))
        sizes = np.minimum(most, length[:active] - at)
        upto, low = np.cumsum(sizes), 0
        while low < active:
            done = int(upto[low - 1]) if low else 0
            high = max(low + 1, int(np.searchsorted(upto, done + SLICE, "right")))
            size = sizes[low:high]
            words = np.arange(int(upto[high - 1]) - done) + np.repeat(begin[low:high] + at - (upto[low:high] - size - done), size)
            word, node, bit = bits_of(code, look(codes, words))
            doc = look(np.repeat(np.arange(low, high), size), word)
            wide = node.astype(np.int64)
            spread = wide.view(np.uint64) * SPREAD
            x = np.empty((INPUTS, len(node)), np.float32)
            slot = [spread_slots(look(look(c, words), word), spread) for c in contexts]
            gate = None
            for i, (table, spot) in enumerate(zip(tables, (wide, *slot))):
                entry = look(table, 2 * spot + bit if left_out else spot)
                x[i] = unpacked(entry)
                if i:
                    step = entry & 3
                    gate = step if gate is None else gate + step * np.uint16(SEEN ** (i - 1))
            mask, base = look(room - 1, doc), look(first, doc)
            wide *= 0x9E3779B1
            wide >>= 7
            alone = base + (wide & mask)
            after = base + (slot[0] & mask)
            for i, spot in enumerate((alone, after)):
                n = pairs(own[i], spot)
                row = np.divide(n.imag, n.real, out=x[3 + i])
                np.log(row, out=row)
                np.minimum(np.maximum(row, -10, out=row), 10, out=row)
            yield low, high, doc, np.searchsorted(doc, np.arange(low, high)), x, gate, bit
            for i, spot in enumerate((alone, after)):
                np.add.at(own[i].reshape(-1), spot * 2 + bit, np.float32(1))
            low = high


def mixed(x: np.ndarray, at: np.ndarray, doc: np.ndarray | None, bit: np.ndarray, weights: np.ndarray, refined: np.ndarray, wanted: bool = True) -> np.ndarray | None:
    """Probability of each choice that was taken, if wanted; then weights (predictor, set) and refinement (document, bin)
    follow, in place. Without `doc` there is one document."""
    z = x[0] * look(weights[0], at)
    for i in range(1, INPUTS):
        z += x[i] * look(weights[i], at)
    np.minimum(np.maximum(z, np.float32(-7.99), out=z), np.float32(7.99), out=z)
    p = np.exp(-z)
    p += 1
    np.reciprocal(p, out=p)
    z += 8
    z *= np.float32((BINS - 1) / 16)
    floor = np.floor(z)
    part = z - floor
    bins = floor.astype(np.int64)
    flat = refined.reshape(-1)
    if doc is not None:
        bins += doc * BINS
    hit = bit.astype(np.float32)
    error, sets = hit - p, weights.shape[1]
    out = None
    if wanted:
        q = look(flat, bins)
        p += q + part * (look(flat, bins + 1) - q)
        p *= np.float32(0.5)
        np.minimum(np.maximum(p, np.float32(1e-5), out=p), np.float32(1 - 1e-5), out=p)
        p += hit
        p -= 1
        out = np.abs(p, out=p)
    scale = RATE / np.sqrt(np.maximum(added_up(at, 1, sets), 1))
    for i in range(INPUTS):
        weights[i] += scale * added_up(at, x[i] * error, sets)
    bins += part > 0.5
    bins *= 2
    bins += bit
    counts = added_up(bins, 1, 2 * len(flat)).reshape(-1, 2)
    hits, ones = counts.sum(1), counts[:, 1]
    flat += (ones - hits * flat) * np.minimum(0.5 / np.maximum(hits, 1), 1 / (hits + 400.0))
    return out


def fit(model: Mixer, code: Code, codes: np.ndarray, per_doc: np.ndarray) -> int:
    """The model's weights and refinement follow training documents, FIT_BITS choices at a time at most; the number of choices."""
    each, n = blocks(model, code, codes, per_doc, left_out=True), 0
    next(each)
    refined = model.refined.reshape(1, -1)
    for _, _, _, _, x, gate, bit in each:
        parts = -(-len(bit) // FIT_BITS)
        for a, b in zip(len(bit) * np.arange(parts) // parts, len(bit) * np.arange(1, parts + 1) // parts):
            mixed(x[:, a:b], gate[a:b].astype(np.int64), None, bit[a:b], model.weights, refined, wanted=False)
        n += len(bit)
    return n


def text_scores(model: Mixer, code: Code, codes: np.ndarray, per_doc: np.ndarray) -> np.ndarray:
    """log10 of each text's probability, an escaped word's own left out; every text starts from the model's state."""
    each = blocks(model, code, codes, per_doc, left_out=False)
    order, out = next(each), np.zeros(len(per_doc))
    weights, refined = np.tile(model.weights, len(per_doc)), np.tile(model.refined, (len(per_doc), 1))
    for low, high, doc, starts, x, gate, bit in each:
        doc -= low
        sets = doc * GATES
        sets += gate
        p = mixed(x, sets, doc, bit, weights[:, low * GATES : high * GATES], refined[low:high])
        if len(p):
            out[low:high] += np.add.reduceat(np.log10(p), starts, dtype=np.float64)
    total = np.empty(len(per_doc))
    total[order] = out
    return total


def loops(spark: SparkSession) -> JavaObject | None:
    own = {k: globals()[k] for k in ("INPUTS", "GATES", "SEEN", "BINS", "RATE", "CONTEXT_BITS", "OWN_BITS", "BLOCK", "LONG_BLOCK", "LONG_AFTER", "FIT_BITS", "SLICE", "CHUNK", "ABREAST", "CUT")}
    return kernel.loops(spark, (*own.items(), ("SPREAD", int(SPREAD.view(np.int64))), ("PRIME", 0x100000001B3)))


def laid_out(code: Code) -> dict[str, np.ndarray | bytes]:
    """The code as the loops in the JVM read it; a choice is twice its node and its bit."""
    ends = np.cumsum([0, *map(len, code.words)])
    if ends[-1] >> 31 or len(code.nodes) >> 31:
        raise ValueError("the code of the common words is too large")
    return {"words": b"".join(code.words), "offsets": ends.astype(np.int32), "sizes": code.size.astype(np.int8), "path": code.nodes.astype(np.int32) * 2 + code.bits, "logs": kernel.LOGARITHMS}


def _texts(batch: pa.RecordBatch) -> pa.Array:
    return pc.ascii_lower(pc.fill_null(batch.column("text"), ""))


def coded(texts: pa.Array, code: Code, values: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Codes of all words with each text's end, tokens per text, and the escaped words with the text of each."""
    words, per_doc = words_of(texts)
    found = pc.index_in(words, value_set=values)
    rare = pc.is_null(found).to_numpy(zero_copy_only=False)
    own = pc.fill_null(found, code.escape).to_numpy().astype(np.int64)
    codes = np.insert(own, np.cumsum(per_doc), code.words.index(b""))
    return codes, per_doc.astype(np.int64) + 1, words.filter(pa.array(rare)), np.repeat(np.arange(len(per_doc)), per_doc)[rare]


def counted_words(docs: DataFrame) -> DataFrame:
    """(word, count): all tokens, and how often training has each (0: held-out text alone). The empty word is the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            held = batch.column("held_out").to_numpy(zero_copy_only=False)
            for out in np.unique(held):
                words, per_doc = words_of(_texts(batch).filter(pa.array(held == out)))
                found = pc.value_counts(words)
                n = np.concatenate((found.field("counts").to_numpy(), [len(per_doc)])) * (1 - int(out))
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([found.field("values"), pa.array([b""], pa.binary())]), pa.array(n.astype(np.int64))], names=["word", "n"])

    return docs.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("count"))


def summed_tables(rows: DataFrame, shape: tuple[int, ...], cut: int) -> np.ndarray:
    """Sum of tables that came in pieces of `cut` numbers (part, own); a task holds the sums of its parts alone."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, own in zip(batch.column("part").to_pylist(), batch.column("own").to_pylist()):
                own = np.frombuffer(own, np.uint32)
                sums[part] = sums[part] + own if part in sums else own.astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([s.astype(np.float32).tobytes() for s in sums.values()], pa.binary())], names=["part", "own"])

    out = np.zeros(int(np.prod(shape)), np.float32)
    for part, own in rows.repartition(32, "part").mapInArrow(total, "part long, own binary").collect():
        out[part * cut : (part + 1) * cut] = np.frombuffer(own, np.float32)
    return out.reshape(shape)


def pieces(counts: np.ndarray, cut: int) -> pa.RecordBatch:
    """A table's pieces that hold anything."""
    flat = counts.reshape(-1, cut)
    full = np.flatnonzero(flat.any(1))
    return pa.RecordBatch.from_arrays([pa.array(full), pa.array([flat[i].tobytes() for i in full], pa.binary())], names=["part", "own"])


def train_mixer(training: DataFrame, code: Code, tokens: int) -> Mixer:
    """Counts of word contexts over all training text; then weights and refinement averaged over tasks that learn online."""
    shape, cut = (2, 1 << CONTEXT_BITS, 2), CUT
    context = training.sparkSession.sparkContext
    compiled = loops(training.sparkSession)
    shared = None if compiled else context.broadcast(code)
    few = training.coalesce(max(context.defaultParallelism, tokens // TABLE_TOKENS))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = shared.value
        counts, values = np.zeros(shape, np.uint32), pa.array(code.words, pa.binary())
        for batch in chunks(batches):
            codes, per_doc, _, _ = coded(_texts(batch), code, values)
            contexts = word_contexts(codes, per_doc) * SPREAD
            for at in range(0, len(codes), COUNTED):
                word, node, bit = bits_of(code, codes[at : at + COUNTED])
                spread = node.astype(np.uint64) * SPREAD
                for i in (0, 1):
                    np.add.at(counts[i].reshape(-1), spread_slots(look(contexts[i][at : at + COUNTED], word), spread) * 2 + bit, np.uint32(1))
        yield pieces(counts, cut)

    schema = "part long, own binary"
    binary = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    if compiled:
        laid = laid_out(code)
        model = Mixer(summed_tables(kernel.mapped(compiled, "count", few.select(binary), laid, schema), shape, cut))
    else:
        model = Mixer(summed_tables(few.mapInArrow(frugal(count), schema), shape, cut))
    tables = None if compiled else context.broadcast(model.left_out(code))

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n, code = Mixer(np.zeros((2, 0, 2), np.float32), seen_less=tables.value), 0, shared.value
        values = pa.array(code.words, pa.binary())
        for batch in chunks(batches, limit=CHUNK):
            codes, per_doc, _, _ = coded(_texts(batch), code, values)
            n += sum(fit(own, code, *part) for part in abreast(codes, per_doc))
        sums = [(n * a.astype(np.float64)).tobytes() for a in (own.weights, own.refined)]
        yield pa.RecordBatch.from_arrays([pa.array([n]), *(pa.array([s], pa.binary()) for s in sums)], names=["n", "weights", "refined"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, w, r = 0, np.zeros(INPUTS * GATES), np.zeros(BINS)
        for batch in batches:
            for m, weights, refined in zip(*(batch.column(c).to_pylist() for c in ("n", "weights", "refined"))):
                n, w, r = n + m, w + np.frombuffer(weights), r + np.frombuffer(refined)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([w.tobytes()], pa.binary()), pa.array([r.tobytes()], pa.binary())], names=["n", "weights", "refined"])

    schema = "n long, weights binary, refined binary"
    if compiled:
        laid |= {f"table{i}": t for i, t in enumerate(model.left_out(code))} | {"weights": model.weights, "refined": model.refined}
        each = kernel.mapped(compiled, "fit", training.select(binary), laid, schema)
    else:
        each = training.mapInArrow(frugal(learned), schema)
    fitted = each.repartition(8).mapInArrow(added, schema).collect()
    n = sum(r["n"] for r in fitted)
    if n:
        mean = lambda c, like: (sum(np.frombuffer(r[c]) for r in fitted) / n).reshape(like.shape).astype(np.float32)
        model.weights, model.refined = mean("weights", model.weights), mean("refined", model.refined)
    return model


def train_speller(words: DataFrame, n_words: int) -> Speller:
    """Tables summed over all training words; then weights and refinement averaged over tasks that each learn online."""
    few = max(1, n_words // TASK_WORDS)
    # However many partitions the shuffle has, no more tasks: each sends its own tables.
    vocabulary = words.select("word").repartition(few, "word").coalesce(few)
    shape, cut = (len(ORDERS), 1 << TABLE_BITS, 2), 1 << 12

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(shape, np.uint32)
        for batch in batches:
            symbols, contexts, _ = spelled(batch.column(0).to_pylist()) if batch.num_rows else (np.zeros(0, np.uint64), np.zeros((len(ORDERS), 0), np.uint64), None)
            for place in range(8):
                bit, node = bit_at(symbols, place)
                for i in range(len(ORDERS)):
                    np.add.at(counts[i].reshape(-1), slots(contexts[i], node) * 2 + bit, np.uint32(1))
        yield pieces(counts, cut)

    model = Speller(summed_tables(vocabulary.mapInArrow(count, "part long, own binary"), shape, cut))
    shared = words.sparkSession.sparkContext.broadcast(model.left_out())

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n = Speller(np.zeros((0, 0, 2), np.float32), seen_less=shared.value), 0
        for batch in batches:
            learn(own, batch.column(0).to_pylist())
            n += batch.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([own.weights.tobytes()], pa.binary()), pa.array([own.refined.tobytes()], pa.binary())], names=["n", "weights", "refined"])

    fitted = vocabulary.sortWithinPartitions(F.xxhash64("word")).mapInArrow(learned, "n long, weights binary, refined binary").collect()
    if fitted:
        fitted.sort(key=lambda r: (r["n"], bytes(r["weights"])))
        n = np.array([r["n"] for r in fitted], float)
        mean = lambda c, shape: np.average([np.frombuffer(r[c]).reshape(shape) for r in fitted], axis=0, weights=n)
        model.weights, model.refined = mean("weights", model.weights.shape), mean("refined", model.refined.shape)
    return model


@dataclass
class Totals:
    """Of training tokens: number, distinct ones; of those that are escaped: number, distinct ones, discount."""

    n: int
    v: int
    rare_n: int
    rare_v: int
    discount: float

    @property
    def spelled(self) -> float:
        """Share of escaped words that spelling accounts for; all, where training has none."""
        return self.discount * self.rare_v / self.rare_n if self.rare_n else 1.0


def code_of(words: DataFrame) -> tuple[Code, Totals, DataFrame]:
    """The code of the common words, totals, and the rows of `words` that the code leaves out.

    Common are words of HEAD_BYTES at most that occur twice, or as often as the least power of two that leaves HEAD of them."""
    short = F.length("word") <= HEAD_BYTES
    grouped = words.where("count > 0").groupBy(F.floor(F.log2("count")).alias("level"), short.alias("short"))
    levels = grouped.agg(F.count_if(F.col("count") > 0).alias("v"), F.sum("count").alias("n"), F.count_if(F.col("count") == 1).alias("once"), F.count_if(F.col("count") == 2).alias("twice")).collect()
    least, room = 62, HEAD
    for r in sorted((r for r in levels if r["short"]), key=lambda r: -r["level"]):
        room -= r["v"]
        if room < 0 or r["level"] < 1:
            break
        least = r["level"]
    common = (F.length("word") == 0) | (short & (F.col("count") >= F.lit(2**least)))
    head = sorted((-r["count"], bytes(r["word"])) for r in words.where(common).collect())
    n, v = sum(r["n"] for r in levels), sum(r["v"] for r in levels)
    once, twice = sum(r["once"] for r in levels), sum(r["twice"] for r in levels)
    rare_n, rare_v = n + sum(c for c, _ in head), v - sum(c < 0 for c, _ in head)
    if not any(not w for _, w in head):
        head.append((0, b""))
    discount = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
    return huffman([w for _, w in head], [-c for c, _ in head], rare_n), Totals(n, v, rare_n, rare_v, discount), words.where(~common)


def with_spelling(words: DataFrame, speller: Speller) -> DataFrame:
    """The same rows and `lp`, log10 of the word's spelled probability."""
    speller.packed()
    speller.counts, speller.seen_less = np.zeros((0, 0, 2), np.float32), None  # scoring reads the packed tables alone
    shared = words.sparkSession.sparkContext.broadcast(speller)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "word"):
            lp = log_probabilities(shared.value, batch.column("word").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("count"), pa.array(lp)], names=["word", "count", "lp"])

    return words.mapInArrow(frugal(run), "word binary, count long, lp double")


def score(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """Learn from the documents outside the held-out fold, and score all.

    Per row of `docs`: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte (of the
    lower-cased text). Tokens are the words, A-Z lower-cased, and one end; a null text is empty. A null doc_id is never
    learned from and counts as held out. Without training text words are only spelled. Rows that repeat get equal
    scores. Extra columns are ignored.

    The code of the commonest words, HEAD at most, is broadcast, as are tables of fixed size. Other words of a document
    are joined with the counts and spellings by word, each spelled once; no such word is common but those of more than
    HEAD_BYTES.
    """
    out = F.coalesce(hashed_to(F.col("doc_id"), folds) == held, F.lit(True))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out"), F.col("text").cast("string").alias("text"))
    training = plain.where(~F.col("held_out")).select("text")
    words = written(counted_words(plain.select("held_out", "text")))
    code, totals, rare_counts = code_of(words)
    speller = train_speller(words.where((F.length("word") > 0) & (F.col("count") > 0)), totals.v)
    mixer = train_mixer(training, code, totals.n)
    known = np.append(code.seen > 0, False)
    base = np.append(np.log10((code.seen + 1) / (totals.n + totals.v + 1)), 0.0)
    mixer.packed(code)
    mixer.counts, mixer.seen_less = np.zeros((2, 0, 2), np.float32), None  # scoring reads the packed tables alone
    compiled = loops(docs.sparkSession)
    shared = None if compiled else docs.sparkSession.sparkContext.broadcast((code, mixer, known, base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, mixer, known, base = shared.value
        values, number = pa.array(code.words, pa.binary()), TaskContext.get().partitionId() << 33
        for batch in chunks(batches, limit=CHUNK):
            texts = _texts(batch)
            codes, per_doc, rare, of = coded(texts, code, values)
            of_token = np.repeat(np.arange(batch.num_rows), per_doc)
            table = rare.dictionary_encode()
            size = max(1, len(table.dictionary))
            key, n = np.unique(of * size + table.indices.to_numpy(), return_counts=True)
            owner, word = np.divmod(key, size)
            lists = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=batch.num_rows)))).astype(np.int32)
            items = pa.StructArray.from_arrays([table.dictionary.take(pa.array(word)), pa.array(n.astype(np.int64))], names=["word", "n"])
            sums = lambda v: np.bincount(of_token, v, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(number + np.arange(batch.num_rows)), batch.column("doc_id"), batch.column("held_out"), pa.array(per_doc), pc.cast(pc.binary_length(texts), pa.int64()), pa.array(sums(known[codes]).astype(np.int64)), pa.array(sums(base[codes])), pa.array(np.concatenate([text_scores(mixer, code, *part) for part in abreast(codes, per_doc)])), pa.ListArray.from_arrays(pa.array(lists), items)],
                names=["row", "doc_id", "held_out", "n_tokens", "n_bytes", "n_known", "base_score", "coded", "rare"],
            )
            number += batch.num_rows

    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_bytes long, n_known long, base_score double, coded double, rare array<struct<word: binary, n: long>>"
    if compiled:
        laid = laid_out(code) | {f"table{i}": t for i, t in enumerate(mixer.packed(code))} | {"weights": mixer.weights, "refined": mixer.refined, "known": known, "base": base}
        binary = F.coalesce(F.col("text"), F.lit("")).cast("binary")
        parts = written(kernel.mapped(compiled, "score", plain.select(binary, "doc_id", "held_out"), laid, schema))
    else:
        parts = written(plain.mapInArrow(frugal(run), schema))
    rare = parts.select("row", F.explode("rare").alias("w")).select("row", F.col("w.word").alias("word"), F.col("w.n").alias("n"))
    joined = rare.join(with_spelling(rare_counts, speller), "word")
    by_spelling = F.log10(F.lit(totals.spelled)) + F.col("lp")
    counted = F.log10((F.col("count") - totals.discount) / max(1, totals.rare_n) + totals.spelled * F.pow(F.lit(10.0), F.col("lp")))
    own = F.when(F.col("count") > 0, counted).otherwise(by_spelling)
    plus_one = F.log10((F.col("count") + 1) / (totals.n + totals.v + 1))
    rest = joined.groupBy("row").agg(F.sum(F.when(F.col("count") > 0, F.col("n")).otherwise(F.lit(0))).alias("more"), F.sum(F.col("n") * plus_one).alias("more_base"), F.sum(F.col("n") * own).alias("more_score"))
    both = parts.drop("rare").join(rest, "row", "left").withColumn("score", F.col("coded") + F.coalesce("more_score", F.lit(0.0)))
    return both.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(totals.n).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        "score",
        (-F.col("score") * float(np.log2(10)) / F.greatest(F.col("n_bytes"), F.lit(1))).alias("bits_per_byte"),
    )
