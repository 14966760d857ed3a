"""Exact Jaccard self-join on word n-grams, by vertical partitioning of the global n-gram order.

The order puts n-grams that are common first found in a bounded sketch last, and else follows their hashes. Any order
gives the exact result; this one keeps common passages out of the prefixes. Two sets that are similar enough share an
n-gram among the first of each (its prefix), so documents that meet in no prefix n-gram need no comparison. Those that
meet are compared fragment by fragment: the order is cut into ranges, each fragment's overlap is counted separately,
and the counts are summed per pair.

Documents of equal sets form a class, and one row per class is compared. In a prefix n-gram's group all classes first
meet one pivot, the class with the fewest n-grams that no other has, which links most copies in a number of pairs linear
in the rows. Components of those links follow, and only classes of different components go on: those of small ones
are paired, and those that may be linked with a large component are compared with all of it, block by block, which
gives a row per link found and none per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, chunks, durable, frugal, words_of, written

#: Slots of the sketch of common n-grams (a byte each, broadcast), and of the smallest and largest filter of documents to
#: compare (a bit each; 32 slots a document as long as that is below the largest).
SLOTS, MOST_SLOTS = 1 << 23, 1 << 28
#: N-grams found so often, counting only tasks that hold them twice, are common.
COMMON = 4
#: Ranges of the global order.
FRAGMENTS = 8
#: N-grams counted together in one task.
COUNTED = 2_000_000
#: Classes of a component from which on it is compared as a whole, and rows of a group that are compared in one task.
LARGE, GROUP = 16, 4096
#: Pivot steps at most; they end when few pairs are left, counted in rows of the groups.
STEPS, FEW = 3, 8
#: Groups of so many rows at most are dealt by their first class, so many of its n-grams together.
SMALL, TOGETHER = 8, 512
#: Of a component's blocks: classes in a block from the least to the most, blocks until the most, n-grams in a block.
LEAST, MOST, BLOCKS, BLOCK_GRAMS = 64, 1024, 32, 1_000_000
#: Columns of a dense matrix of n-grams.
COLUMNS = 4096


def gram_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Each text's set of n-gram hashes, ascending; fewer than n words count as one gram, none as the empty set."""
    words, counts = words_of(pc.ascii_lower(pc.fill_null(texts, "")))
    if not len(words):
        return [np.zeros(0, np.int64)] * len(counts)
    coded = words.dictionary_encode()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))[coded.indices.to_numpy()]
    mixed = np.zeros(len(hashes), np.uint64)
    for k in range(n):  # windows that run into the next text are left out below
        part = hashes[k:] if k else hashes
        mixed[: len(part)] ^= part
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    out, at = [], 0
    for count in counts.tolist():
        if count >= n:
            own = mixed[at : at + count - n + 1]
        else:
            own = np.array([xxhash.xxh3_64_intdigest(hashes[at : at + count].tobytes(), seed=count)] if count else [], np.uint64)
        out.append(np.unique(own.view(np.int64)))
        at += count
    return out


FOUND = "doc_id long, n long, class long, gram long, found long"


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))


def class_of(grams: np.ndarray) -> int | None:
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63) if len(grams) else None


def survey(docs: DataFrame, n: int) -> DataFrame:
    """Of each document the set's size and class; and n-grams that a task holds twice or more, with their counts.

    Sets are not stored: at 8 bytes a word they are larger than the text, and few are needed again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def rows(doc_id, size, class_, gram, found) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (doc_id, size, class_, gram, found)], names=["doc_id", "n", "class", "gram", "found"])

        def counted() -> pa.RecordBatch:
            grams, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            none = [None] * int((counts > 1).sum())
            return rows(none, none, none, grams[counts > 1], counts[counts > 1])

        for batch in chunks(batches):
            sets = gram_sets(batch.column("text"), n)
            none = [None] * len(sets)
            yield rows(batch.column("doc_id").to_pylist(), [len(s) for s in sets], [class_of(s) for s in sets], none, none)
            held += sets
            if sum(map(len, held)) > COUNTED:
                yield counted()
        if held:
            yield counted()

    return docs.mapInArrow(frugal(run), FOUND)


def slot_table(rows: DataFrame, slot: str, value: str, slots: int, bits: bool) -> np.ndarray:
    """The largest value (a byte) in each slot, on the driver: `slots` bytes, or bits, whatever the table's size."""
    part = 1 << 12

    def run(key: tuple, table: pa.Table) -> pa.Table:
        own = np.zeros(part, np.uint8)
        np.maximum.at(own, table.column("at").to_numpy(), table.column("v").to_numpy().astype(np.uint8))
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([np.packbits(own).tobytes() if bits else own.tobytes()], pa.binary())], names=["part", "own"])

    dealt = rows.select(F.floor(F.col(slot) / part).cast("long").alias("part"), (F.col(slot) % part).cast("long").alias("at"), F.col(value).cast("long").alias("v"))
    dealt = dealt.groupBy("part", "at").agg(F.max("v").alias("v"))
    out = np.zeros(slots // (8 if bits else 1), np.uint8)
    step = part // (8 if bits else 1)
    for number, own in dealt.groupBy("part").applyInArrow(run, "part long, own binary").collect():
        out[number * step : (number + 1) * step] = np.frombuffer(own, np.uint8)
    return out


def common_levels(found: DataFrame) -> np.ndarray:
    """For each slot, the order of magnitude of its commonest n-gram; 0 for n-grams that are not common."""
    common = found.where("gram IS NOT NULL").groupBy("gram").agg(F.sum("found").alias("found")).where(F.col("found") >= COMMON)
    return slot_table(common.select(F.pmod("gram", F.lit(SLOTS)).alias("slot"), F.floor(F.log2("found")).alias("level")), "slot", "level", SLOTS, False)


def prefix_length(n, percent: int):
    return n - (percent * n + 99) // 100 + 1


def _joined(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All grams in a row, the sets' sizes, and each gram's set."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    return np.concatenate(sets), sizes, np.repeat(np.arange(len(sizes)), sizes)


def prefix_rows(docs: DataFrame, levels, n: int, percent: int) -> DataFrame:
    """(gram, class, n, position) for each set's prefix: its first grams in the global order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        for batch in chunks(batches):
            sets = gram_sets(batch.column("text"), n)
            classes = np.array([class_of(s) or 0 for s in sets], np.int64)
            grams, sizes, owner = _joined(sets)
            order = np.lexsort((grams, level[grams % SLOTS], owner))
            position = np.arange(len(grams)) - (np.cumsum(sizes) - sizes)[owner]
            chosen = position < prefix_length(sizes, percent)[owner]
            own = owner[chosen]
            yield pa.RecordBatch.from_arrays([pa.array(grams[order][chosen]), pa.array(classes[own]), pa.array(sizes[own]), pa.array(position[chosen])], names=["gram", "class", "n", "position"])

    return docs.select("text").mapInArrow(frugal(run), "gram long, class long, n long, position long")


def _changes(rows: dict[str, np.ndarray], key: list[str]) -> np.ndarray:
    """Whether each row starts a group of its own."""
    return np.concatenate(([True], np.any([np.diff(rows[c]) != 0 for c in key], axis=0)))


def _grouped(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Rows sorted by key, in pieces that hold whole groups."""
    held: list[dict[str, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = {c: batch.column(c).to_numpy() for c in batch.schema.names}
        cut = int(np.flatnonzero(_changes(rows, key))[-1])
        if cut == 0 and (not held or all(held[0][c][0] == rows[c][0] for c in key)):
            held.append(rows)
            continue
        ready = [*held, {c: v[:cut] for c, v in rows.items()}]
        yield {c: np.concatenate([r[c] for r in ready]) for c in rows}
        held = [{c: v[cut:] for c, v in rows.items()}]
    if held:
        yield {c: np.concatenate([r[c] for r in held]) for c in held[0]}


def _need(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of two sets of these sizes that are similar enough."""
    return (percent * (n + m) + 99 + percent) // (100 + percent)


def _hopeful(rows: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Pairs that their sizes and the n-gram's positions allow to be similar enough, as hopeful()."""
    n, m, p, q = rows["n"][a], rows["n"][b], rows["position"][a], rows["position"][b]
    fits = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
    rest = (percent * np.maximum(n, m) + 99) // 100 - 1
    return fits & (np.minimum(rows["matched"][a] - p, rows["matched"][b] - q) + np.minimum(p, q) + rest >= _need(n, m, percent))


PAIR = "a long, b long, n_a long, n_b long, shared long"


def _pairs(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """Distinct pairs, the smaller class first, with sizes and the number of n-grams they were found by."""
    p, q, n, m = (np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.int64) for i in range(4))
    swap = p > q
    p, q, n, m = np.where(swap, q, p), np.where(swap, p, q), np.where(swap, m, n), np.where(swap, n, m)
    order = np.lexsort((q, p))
    p, q, n, m = p[order], q[order], n[order], m[order]
    new = np.flatnonzero(np.concatenate(([True], (np.diff(p) != 0) | (np.diff(q) != 0)))) if len(p) else np.zeros(0, np.int64)
    shared = np.diff(np.append(new, len(p)))
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (p[new], q[new], n[new], m[new], shared)], names=["a", "b", "n_a", "n_b", "shared"])


def rest_of(n: Column, percent: int) -> Column:
    """How many n-grams of a set of this size come after its prefix."""
    return F.floor((percent * n + 99) / 100).cast("long") - 1


def need_of(n: Column, m: Column, percent: int) -> Column:
    return F.ceil(percent * (n + m) / (100 + percent))


def likely(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs whose number of shared prefix n-grams leaves the least overlap possible.

    What two sets share is in both prefixes, or comes after the end of one prefix in the order, and of that there is
    no more than the rest of that set."""
    summed = pairs.groupBy("a", "b", "n_a", "n_b").agg(F.sum("shared").alias("shared"))
    n, m = F.col("n_a"), F.col("n_b")
    return summed.where(F.col("shared") + rest_of(F.greatest(n, m), percent) >= need_of(n, m, percent)).select("a", "b")


def shared_groups(prefixes: DataFrame) -> DataFrame:
    """Prefix rows of n-grams that two classes or more share, one per class: (gram, class, n, position, matched).

    `position` counts such n-grams only, and `matched` is how many of them the class has. A large group's rows meet in
    joins and sums, which need them in no single task; a class's rows are those of one document.
    """
    rows = prefixes.groupBy("gram", "class").agg(F.min("n").alias("n"), F.min("position").alias("position"))
    shared = rows.groupBy("gram").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("gram")
    own = Window.partitionBy("class")
    place = (F.row_number().over(own.orderBy("position", "gram")) - 1).cast("long")
    return rows.join(shared, "gram").select("gram", "class", "n", place.alias("position"), F.count("*").over(own).alias("matched"))


def hopeful(percent: int) -> Column:
    """Whether sizes and an n-gram's positions allow a row's class and its pivot to be similar enough.

    Of the n-grams that both prefixes hold, no more come before this one than either's position says, and no more
    from it on than either has left; others come after the end of one prefix."""
    n, m, p, q = (F.col(c) for c in ("n", "p_n", "position", "p_position"))
    fits = 100 * F.least(n, m) >= percent * F.greatest(n, m)
    most = F.least(F.col("matched") - p, F.col("p_matched") - q) + F.least(p, q) + rest_of(F.greatest(n, m), percent)
    return fits & (most >= need_of(n, m, percent))


def open_groups(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of groups in which components still differ, with label and k (classes) of their component."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("k"))
    labelled = groups.join(labels.join(sizes, "label"), "class", "left").withColumns({"label": F.coalesce("label", "class"), "k": F.coalesce("k", F.lit(1))})
    differ = labelled.groupBy("gram").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("gram")
    return written(labelled.join(differ, "gram"))


def pairs_left(small: DataFrame) -> tuple[int, int]:
    """Rows of groups, and pairs of them with different labels."""
    own = small.groupBy("gram", "label").agg(F.count("*").cast("double").alias("c"))
    each = own.groupBy("gram").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("same"))
    found = each.agg(F.sum("m").alias("rows"), (F.sum(F.col("m") * F.col("m") - F.col("same")) / 2).alias("pairs")).first()
    return found["rows"] or 0, found["pairs"] or 0


def pivot_pairs(groups: DataFrame, step: int, percent: int) -> DataFrame:
    """Each class of a group with the group's pivot of this step, if their labels differ: a row per row at most.

    The first step's pivot is the class with the smallest share of prefix n-grams that no other class has; later ones are
    first by a hash. The order is the same in all groups, so a class that is a pivot is one wherever it can be. A pivot's
    rows and the others' meet in a join, which can split a large group.
    """
    lost = F.floor(1000 * (F.col("n") - rest_of(F.col("n"), percent) - F.col("matched")) / F.col("n")).cast("long") if step == 0 else F.lit(0).cast("long")
    rows = groups.withColumn("order", F.shiftleft(lost, 50) + F.shiftrightunsigned(F.xxhash64("class", F.lit(step)), 14))
    first = rows.groupBy("gram").agg(F.min("order").alias("order"))
    pivots = rows.join(first, ["gram", "order"]).select("gram", *(F.col(c).alias(f"p_{c}") for c in ("class", "n", "position", "matched", "label")))
    met = rows.join(pivots, "gram").where((F.col("label") != F.col("p_label")) & hopeful(percent))
    low = F.col("class") < F.col("p_class")
    pick = lambda x, y, name: F.when(low, F.col(x)).otherwise(F.col(y)).alias(name)
    pairs = met.select(pick("class", "p_class", "a"), pick("p_class", "class", "b"), pick("n", "p_n", "n_a"), pick("p_n", "n", "n_b"))
    return likely(pairs.withColumn("shared", F.lit(1)), percent)


def cross_pairs(groups: DataFrame, percent: int) -> DataFrame:
    """All pairs of a group whose labels differ. Equal labels: known to be linked, so the pair adds nothing.

    A large group is dealt to blocks by hash, and every two blocks are compared in a task of their own. Small groups with
    the same first class stand together, so that a pair found by many n-grams is a row for each few hundred of them, and
    not for each.
    """
    n = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = groups.groupBy("gram").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("blocks"), F.count("*").alias("rows"), F.min(F.struct("class", "matched")).alias("first"))
    share = F.pmod("gram", F.ceil(F.col("first.matched") / TOGETHER).cast("long"))
    home = F.when(F.col("rows") <= SMALL, F.xxhash64("first.class", share)).otherwise(F.xxhash64("gram"))
    sizes = sizes.select("gram", "blocks", home.alias("home"))
    dealt = groups.join(sizes, "gram").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks").cast("long")).cast("int"))
    sent = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    key = ["gram", "low", "high"]
    sent = sent.select("home", "gram", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "class", "n", "position", "matched", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, key):
            starts = np.flatnonzero(_changes(rows, key))
            stops = np.append(starts[1:], len(rows["gram"]))
            found, waiting = [], 0
            for start, stop in zip(starts.tolist(), stops.tolist()):
                label, block = rows["label"][start:stop], rows["block"][start:stop]
                if label[0] == label[-1]:  # sorted by label
                    continue
                ends = start + np.searchsorted(label, label, "right")
                across = rows["low"][start] != rows["high"][start]
                for i in range(start, stop):
                    b = np.arange(int(ends[i - start]), stop)
                    if not len(b):
                        break
                    if across:  # pairs inside a block are found where it meets itself
                        b = b[rows["block"][b] != block[i - start]]
                    b = b[_hopeful(rows, np.full(len(b), i), b, percent)]
                    found.append((np.full(len(b), rows["class"][i]), rows["class"][b], np.full(len(b), rows["n"][i]), rows["n"][b]))
                    waiting += len(b)
                    if waiting > 500_000:
                        yield _pairs(found)
                        found, waiting = [], 0
            if found:
                yield _pairs(found)

    pairs = sent.repartition(n, "home", "low", "high").sortWithinPartitions("home", *key, "label", "class").mapInArrow(frugal(run), PAIR)
    return likely(pairs, percent)


def partners(groups: DataFrame, percent: int) -> DataFrame:
    """(label, class): the classes that may be linked with a class of another, large component. Of two large
    components the smaller one's classes are partners of the other."""
    large = groups.where(F.col("k") >= LARGE).groupBy("gram", F.col("label").alias("of"), F.col("k").alias("of_k")).agg(F.max("matched").alias("most"), F.min("n").alias("low"), F.max("n").alias("high"))
    n, low, high = F.col("n"), F.col("low"), F.col("high")
    apart = (F.col("of") != F.col("label")) & ((F.col("k") < F.col("of_k")) | ((F.col("k") == F.col("of_k")) & (F.col("label") < F.col("of"))))
    fits = (100 * n >= percent * low) & (100 * high >= percent * n)
    least = need_of(n, F.greatest(low, F.ceil(percent * n / 100)), percent)
    most = F.least(F.col("matched"), F.col("most")) + rest_of(F.greatest(n, F.least(high, F.floor(100 * n / percent))), percent)
    return groups.join(large, "gram").where(apart & fits & (most >= least)).select(F.col("of").alias("label"), "class").distinct()


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class")))


def fragments_of(docs: DataFrame, representatives: DataFrame, wanted: DataFrame, levels, n: int) -> DataFrame:
    """(class, n, fragment, grams) of the classes in `wanted`, made again from one document's text each.

    A filter of bits picks the documents, so that nearly no other set is made; what it lets through by chance finds
    no pair.
    """
    spots = written(wanted.distinct().join(representatives, "class").select("doc_id"))
    slots = int(np.clip(1 << (32 * spots.count()).bit_length(), SLOTS, MOST_SLOTS))
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(slots))
    chosen = docs.sparkSession.sparkContext.broadcast(slot_table(spots.select(slot.alias("slot"), F.lit(1).alias("one")), "slot", "one", slots, True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, bits = levels.value, chosen.value

        def picked(batch: pa.RecordBatch) -> pa.RecordBatch:
            at = batch.column("slot").to_numpy()
            return batch.filter(pa.array((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)))

        for batch in chunks(map(picked, batches)):
            sets = [s for s in gram_sets(batch.column("text"), n) if len(s)]
            if not sets:
                continue
            classes = np.array([class_of(s) for s in sets], np.int64)
            grams, sizes, owner = _joined(sets)
            range_ = ((grams >> 32) + (1 << 31)) * (FRAGMENTS - 1) >> 32
            fragment = np.where(level[grams % SLOTS] > 0, FRAGMENTS - 1, range_)
            order = np.lexsort((grams, fragment, owner))
            key = (owner * FRAGMENTS + fragment)[order]
            starts = np.flatnonzero(np.concatenate(([True], np.diff(key) != 0)))
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(key)).astype(np.int32)), pa.array(grams[order]))
            own = key[starts] // FRAGMENTS
            yield pa.RecordBatch.from_arrays([pa.array(classes[own]), pa.array(sizes[own]), pa.array((key[starts] % FRAGMENTS).astype(np.int32)), lists], names=["class", "n", "fragment", "grams"])

    rows = docs.select("text", slot.alias("slot"))
    return rows.mapInArrow(frugal(run), "class long, n long, fragment int, grams array<long>").dropDuplicates(["class", "fragment"])


def links(pairs: DataFrame, fragments: DataFrame, percent: int) -> DataFrame:
    """The pairs that are similar enough: partial overlaps counted by fragment, summed per pair."""
    left = fragments.select(F.col("class").alias("a"), F.col("n").alias("n_a"), "fragment", F.col("grams").alias("grams_a"))
    right = fragments.select(F.col("class").alias("b"), F.col("n").alias("n_b"), "fragment", F.col("grams").alias("grams_b"))
    both = pairs.join(left, "a").join(right, ["b", "fragment"])
    partial = both.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("grams_a", "grams_b")).cast("long").alias("overlap"))
    summed = partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("overlap").alias("overlap"))
    return summed.where(100 * F.col("overlap") >= percent * (F.col("n_a") + F.col("n_b") - F.col("overlap"))).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(class, label) of every class with an edge: the smallest class that edges lead to.

    Each round takes the smallest label among neighbours and then the label's own label, so long chains shrink
    by half at least; the rounds end when nothing changes.
    """
    both = durable(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = durable(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("class"), F.least("a", "m").alias("label")))
    while True:
        near = both.join(labels.select(F.col("class").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "class"), "class").select("class", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        onward = step.select(F.col("class").alias("label"), F.col("label").alias("next"))
        step = durable(step.join(onward, "label").select("class", "old", F.least("label", "next").alias("label")))
        labels = step.select("class", "label")
        if step.where("label <> old").isEmpty():
            return labels


def overlaps(grams: np.ndarray, owner: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many n-grams the sets `left` share with the sets `right`; grams[i] is in set owner[i]."""
    out = np.zeros((len(left), len(right)), np.int64)
    _, code, count = np.unique(grams, return_inverse=True, return_counts=True)
    shared = count > 1
    code, owner = (np.cumsum(shared) - 1)[code[shared[code]]], owner[shared[code]]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    for first in range(0, int(shared.sum()), COLUMNS):
        start, stop = np.searchsorted(code, (first, first + COLUMNS))
        held = np.zeros((int(max(left.max(), right.max())) + 1, COLUMNS), np.float32)
        held[owner[start:stop], code[start:stop] - first] = 1
        out += (held[left] @ held[right].T).astype(np.int64)
    return out


def block_of(blocks: str) -> Column:
    return F.pmod(F.xxhash64("class"), F.col(blocks).cast("long")).cast("int")


def blocks_for(k: str, grams: str) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.col(k) / MOST), F.ceil(F.col(grams) / BLOCK_GRAMS)).cast("int")


def partner_links(pairs: DataFrame, labels: DataFrame, sets: DataFrame, representatives: DataFrame, percent: int) -> DataFrame:
    """(a, b): for each partner of a large component and block of it, a link that joins them, if there is one.

    The component's classes and its partners are dealt to blocks, and every two blocks meet in one task, where
    overlaps are counted range by range of the n-grams and summed per pair."""
    size = representatives.select("class", "n")
    members = labels.join(pairs.select("label").distinct(), "label").join(size, "class").select("label", "class", "n", F.lit(False).alias("guest"))
    guests = pairs.join(size, "class").select("label", "class", "n", F.lit(True).alias("guest"))
    both = members.union(guests)
    sums = [F.sum(F.when(F.col("guest") == F.lit(g), x).otherwise(F.lit(0))).alias(f"{name}{g:d}") for g in (False, True) for name, x in (("k", F.lit(1)), ("g", F.col("n")))]
    counts = both.groupBy("label").agg(*sums).select("label", blocks_for("k0", "g0").alias("own_blocks"), blocks_for("k1", "g1").alias("guest_blocks"))
    dealt = both.join(counts, "label").withColumn("at", F.when(F.col("guest"), block_of("guest_blocks")).otherwise(block_of("own_blocks")))
    sent = dealt.join(sets, "class").select("label", "class", "guest", "at", "grams", F.explode(F.sequence(F.lit(0), F.when(F.col("guest"), F.col("own_blocks")).otherwise(F.col("guest_blocks")) - 1)).alias("other"))
    sent = sent.select("label", "class", "guest", F.when(F.col("guest"), F.col("other")).otherwise(F.col("at")).alias("own"), F.when(F.col("guest"), F.col("at")).otherwise(F.col("other")).alias("visit"), "grams")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        guest, class_ = table.column("guest").to_numpy(), table.column("class").to_numpy()
        near, left, right = similar_rows(table, ~guest, guest, percent)
        hit = near.any(0) if len(left) else np.zeros(len(right), bool)
        own = left[near.argmax(0)[hit]] if hit.any() else np.zeros(0, np.int64)
        x, y = class_[own], class_[right[hit]]
        return pa.table([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return sent.groupBy("label", "own", "visit").applyInArrow(run, "a long, b long")


def similar_rows(table: pa.Table, left: np.ndarray, right: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each of a table's left rows is similar enough to each right row, and the rows' numbers."""
    lists = table.column("grams").combine_chunks()
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    left, right = np.flatnonzero(left), np.flatnonzero(right)
    if not len(left) or not len(right):
        return np.zeros((len(left), len(right)), bool), left, right
    overlap = overlaps(lists.flatten().to_numpy(), np.repeat(np.arange(len(size)), size), left, right)
    return (100 * overlap >= percent * (size[left][:, None] + size[right] - overlap)) & (left[:, None] != right), left, right


def link_counts(sets: DataFrame, representatives: DataFrame, labels: DataFrame, edges: DataFrame, percent: int) -> DataFrame:
    """(class, n_links) of every class with an edge: to how many other classes it is similar enough.

    `edges` leave out pairs of which a path of links was known. All links are inside components. Where a component's
    edges are all its pairs, they are counted; the classes of others are dealt to blocks by hash, and every two blocks
    are compared in one task, which gives a row per class and not per pair.
    """
    sized = labels.join(representatives.select("class", "n"), "class")
    known = edges.join(labels.withColumnRenamed("class", "a"), "a").groupBy("label").agg(F.count("*").alias("known"))
    blocks = F.greatest(F.ceil(F.col("k") / MOST), F.least(F.lit(BLOCKS), F.ceil(F.col("k") / LEAST)), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("int")
    groups = sized.groupBy("label").agg(F.count("*").alias("k"), F.sum("n").alias("grams")).join(known, "label")
    groups = groups.select("label", "k", blocks.alias("blocks"), (2 * F.col("known") == F.col("k") * (F.col("k") - 1)).alias("whole"))
    dealt = written(labels.join(groups, "label"))
    open_ = dealt.where(~F.col("whole")).select("class", "label", "blocks", block_of("blocks").alias("block"))
    sent = open_.join(sets, "class").select("class", "label", "block", "grams", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    sent = sent.select("class", "label", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "grams")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        low, high = key[1].as_py(), key[2].as_py()
        block, class_ = table.column("block").to_numpy(), table.column("class").to_numpy()
        near, left, right = similar_rows(table, block == low, block == high, percent)
        found = np.zeros(len(class_), np.int64)
        found[left] += near.sum(1)
        if low != high:
            found[right] += near.sum(0)
        return pa.table([pa.array(class_), pa.array(found)], names=["class", "n_links"])

    counted = sent.groupBy("label", "low", "high").applyInArrow(run, "class long, n_links long").groupBy("class").agg(F.sum("n_links").alias("n_links"))
    return dealt.where("whole").select("class", (F.col("k") - 1).alias("n_links")).union(counted)


def _similar(docs: DataFrame, n: int, percent: int, counted: bool) -> DataFrame:
    docs = _plain(docs)
    found = written(survey(docs, n))
    own = found.where("gram IS NULL").select("doc_id", "n", "class")
    representatives = written(own.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n")))
    levels = docs.sparkSession.sparkContext.broadcast(common_levels(found))
    groups = written(shared_groups(prefix_rows(docs, levels, n, percent)))
    open_ = groups.withColumns({"label": F.col("class"), "k": F.lit(1).cast("long")})
    compared = edges = None
    for step in range(STEPS):
        pairs = pivot_pairs(open_, step, percent)
        pairs = written(pairs.join(compared, ["a", "b"], "left_anti") if step else pairs)
        found = written(links(pairs, fragments_of(docs, representatives, ends_of(pairs), levels, n), percent))
        compared, edges = (compared.union(pairs), edges.union(found)) if step else (pairs, found)
        labels = components(edges)
        open_ = open_groups(groups, labels)
        rows, left = pairs_left(open_.where(F.col("k") < LARGE))
        if left <= FEW * rows:
            break
    rest = written(cross_pairs(open_.where(F.col("k") < LARGE), percent).join(compared, ["a", "b"], "left_anti"))
    guests = written(partners(open_, percent))
    wanted = ends_of(rest).union(guests.select("class")).union(labels.select("class"))
    fragments = written(fragments_of(docs, representatives, wanted, levels, n))
    sets = fragments.groupBy("class").agg(F.flatten(F.collect_list("grams")).alias("grams"))
    more = links(rest, fragments, percent).union(partner_links(guests, labels, sets, representatives, percent))
    edges = written(edges.union(more).distinct())
    labels = components(edges)
    degree = link_counts(sets, representatives, labels, edges, percent) if counted else labels.select("class", F.lit(None).cast("long").alias("n_links"))
    smallest = labels.join(representatives, "class").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    linked = labels.join(smallest, "label").join(degree, "class").select("class", "component_id", "n_links")
    classes = representatives.join(linked, "class", "left").select("class", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = own.join(classes, "class", "left")
    plain = lambda c: F.when(c != NULL_ID, c)
    return out.select(plain(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("n_links", F.lit(0)).alias("n_links"), plain(F.coalesce("component_id", "doc_id")).alias("component_id"))


def similar_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Per row of `docs`: doc_id, n_shingles, n_links (of its class, to all other classes) and component_id.

    A document's set is that of its n-word shingles (A-Z lower-cased), or its whole sequence of fewer words; documents
    without words have none and are linked with nothing. Two documents link when 100 * intersection >= percent *
    union. component_id is the smallest doc_id reachable. Rows that repeat a doc_id are documents of their own with
    that id; a null doc_id sorts first and is returned as null. Other columns are ignored; an empty table gives no rows.
    """
    return _similar(docs, n, percent, True)


#: Rows of a list of dropped documents that may be broadcast.
BROADCAST_ROWS = 1_000_000


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` whose doc_id is the smallest of their component. Documents without words stay, and rows
    that repeat a doc_id stay or go together."""
    found = _similar(docs.select("doc_id", "text"), n, percent, False)
    gone = written(found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__gone")).distinct())
    small = gone.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if small else gone, F.col("doc_id").eqNullSafe(F.col("__gone")), "left_anti")
