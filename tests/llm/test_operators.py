"""Each operator against a plain version, on awkward rows, empty tables and clashing columns."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from pyspark.sql import functions as F

from maskwell.llm import chat, context_mixing, fingerprint, jaccard_join, language_id, line_dedup, mixing, packing, quality, token_counts

from .cases import CLASHING, DOCS, LOWER, documents, fold, rows, sentence, words

TEXTS = {r[0]: r[1] for r in rows()}


def by_id(df):
    out = {r["doc_id"]: r for r in df.collect()}
    assert set(out) == set(TEXTS)
    return out


# 1


def test_base_scores_are_exact_and_model_is_normalised(spark):
    out = by_id(context_mixing.score(documents(spark, extra=True)))
    tokens = {i: words((t or "").translate(LOWER)) + ["\n"] for i, t in TEXTS.items()}
    count = collections.Counter(w for i, own in tokens.items() if fold(i, 7) != 2 for w in own)
    n, v = sum(count.values()), len(count)
    for i, own in tokens.items():
        r = out[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(own), sum(count[w] > 0 for w in own), n, fold(i, 7) == 2)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own), abs=1e-6)
        assert r["score"] < 0 and math.isfinite(r["score"])


def test_spelled_probabilities_sum_to_at_most_one():
    rng = np.random.default_rng(0)
    vocabulary = [bytes(rng.integers(97, 101, rng.integers(1, 5)).tolist()) for _ in range(500)]
    model = context_mixing.Speller(np.zeros((len(context_mixing.ORDERS), 1 << context_mixing.TABLE_BITS, 2), np.float32))
    symbols, contexts, _ = context_mixing.spelled(vocabulary)
    for place in range(8):
        bit, node = context_mixing.bit_at(symbols, place)
        for i in range(len(context_mixing.ORDERS)):
            np.add.at(model.counts[i], (context_mixing.slots(contexts[i], node), bit), 1)
    before = context_mixing.log_probabilities(model, vocabulary).mean()
    context_mixing.learn(model, vocabulary * 3)
    assert context_mixing.log_probabilities(model, vocabulary).mean() > before
    one = [bytes([b]) for b in range(256)]
    total = sum(10 ** context_mixing.log_probabilities(model, [b[:1] for b in one if b != b"\0"]))
    assert total + 10 ** context_mixing.log_probabilities(model, [b""])[0] <= 1 + 1e-9


def prose(seed: int, n: int) -> list[bytes]:
    """Words of a chain in which each word has two likely followers."""
    drawn, word, out = random.Random(seed), 0, []
    for _ in range(n):
        word = (word * 7 + drawn.choice([3, 11])) % 60 if drawn.random() < 0.9 else drawn.randrange(60)
        out.append(b"w%d" % word)
    return out


def trained(texts: list[list[bytes]]):
    count = collections.Counter(w for t in texts for w in [*t, b""])
    code = context_mixing.huffman(list(count), list(count.values()), 5)
    codes, per_doc = coded_words(code, texts)
    model = context_mixing.Mixer(np.zeros((2, 1 << context_mixing.CONTEXT_BITS, 2), np.float32))
    contexts = context_mixing.word_contexts(codes, per_doc)
    word, node, bit = context_mixing.bits_of(code, codes)
    for i in (0, 1):
        np.add.at(model.counts[i].reshape(-1), context_mixing.context_slots(contexts[i][word], node) * 2 + bit, 1)
    context_mixing.fit(model, code, codes, per_doc)
    return model, code


def coded_words(code, texts):
    at = {w: i for i, w in enumerate(code.words)}
    return np.array([at.get(w, code.escape) for t in texts for w in [*t, b""]]), np.array([len(t) + 1 for t in texts])


def test_code_is_a_prefix_code():
    code = context_mixing.huffman([b"a", b"b", b"", b"c"], [50, 20, 3, 1], 0)
    paths = ["".join(map(str, code.bits[s : s + n])) for s, n in zip(code.start, code.size)]
    assert len(paths) == 5 and sum(2.0 ** -len(p) for p in paths) == 1 and len(paths[0]) == 1
    assert not any(a != b and b.startswith(a) for a in paths for b in paths)


def test_scores_follow_word_order_and_the_text_so_far():
    model, code = trained([prose(i, 400) for i in range(40)])
    text = prose(99, 600)
    shuffled = random.Random(1).sample(text, len(text))
    scores = context_mixing.text_scores(model, code, *coded_words(code, [text, shuffled, text + text, []]))
    unigram = sum(math.log10(code.seen[code.words.index(w)] / code.seen.sum()) for w in [*text, b""])
    assert scores[0] > 0.8 * unigram and scores[0] > scores[1] * 0.9
    # The second time over, the text itself tells more than training did.
    assert scores[2] > 1.98 * scores[0]
    # A text's score is its own: neighbours in a batch do not count.
    for i, t in enumerate([text, shuffled, text + text, []]):
        assert context_mixing.text_scores(model, code, *coded_words(code, [t]))[0] == pytest.approx(scores[i], abs=1e-3)


def test_mixing_equals_a_plain_loop():
    rng, m = np.random.default_rng(5), context_mixing
    x, bit = rng.normal(size=(m.INPUTS, 200)).astype(np.float32), rng.integers(0, 2, 200)
    doc, gate = np.sort(rng.integers(0, 3, 200)), rng.integers(0, m.GATES, 200)
    start, table = np.full((m.INPUTS, 3 * m.GATES), 0.3, np.float32), np.tile(m.Mixer(np.zeros(0)).refined, (3, 1))
    weights, refined = start.astype(float), table.astype(float)
    got_w, got_r = start.copy(), table.copy()
    got = m.mixed(x, doc * m.GATES + gate, doc, bit, got_w, got_r)
    steps, seen, near = np.zeros_like(weights), collections.Counter((doc * m.GATES + gate).tolist()), collections.defaultdict(list)
    for j in range(200):
        at = doc[j] * m.GATES + gate[j]
        z = min(7.99, max(-7.99, sum(float(x[i, j]) * weights[i, at] for i in range(m.INPUTS))))
        p, spot = 1 / (1 + math.exp(-z)), (z + 8) / 16 * (m.BINS - 1)
        low = int(spot)
        q = refined[doc[j], low] * (low + 1 - spot) + refined[doc[j], low + 1] * (spot - low)
        mean = min(1 - 1e-5, max(1e-5, (p + q) / 2))
        assert got[j] == pytest.approx(mean if bit[j] else 1 - mean, abs=1e-5)
        for i in range(m.INPUTS):
            steps[i, at] += m.RATE / math.sqrt(seen[at]) * x[i, j] * (bit[j] - p)
        near[doc[j], low + (spot - low > 0.5)].append(bit[j])
    assert np.allclose(got_w, weights + steps, atol=1e-5)
    for (d, b), bits in near.items():
        share = min(0.5, len(bits) / (len(bits) + 400))
        refined[d, b] += share * (np.mean(bits) - refined[d, b])
    assert np.allclose(got_r, refined, atol=1e-5)


def test_texts_score_the_same_whatever_is_mixed_with_them(monkeypatch):
    code = context_mixing.huffman([b"a", b"b", b"", b"c"], [50, 20, 3, 1], 0)
    r = random.Random(5)
    codes, per_doc = coded_words(code, [[r.choice([b"a", b"b", b"c"]) for _ in range(n)] for n in (700, 3, 0, 90, 90, 1200)])
    model = context_mixing.Mixer(np.zeros((2, 1 << context_mixing.CONTEXT_BITS, 2), np.float32))
    whole = context_mixing.text_scores(model, code, codes, per_doc)
    monkeypatch.setattr(context_mixing, "SLICE", 1)
    monkeypatch.setattr(context_mixing, "ABREAST", 100)
    parts = list(context_mixing.abreast(codes, per_doc))
    assert len(parts) > 2 and sum(len(c) for c, _ in parts) == len(codes)
    assert np.concatenate([context_mixing.text_scores(model, code, *p) for p in parts]) == pytest.approx(whole, rel=1e-4)


def test_packed_tables_leave_out_one_sight():
    counts = np.array([[0, 0], [1, 0], [3, 70], [400, 2], [1e6, 0]], np.float32)
    less = context_mixing.less_packed(counts).reshape(-1, 2)
    for bit in (0, 1):
        left = np.maximum(counts - np.eye(2, dtype=np.float32)[bit], 0)
        assert context_mixing.unpacked(less[:, bit]) == pytest.approx(context_mixing.stretched(left[:, 0], left[:, 1]), abs=1 / 1000)
        assert (less[:, bit] & 3).tolist() == context_mixing.gate_step(left.sum(1)).tolist()


def test_loops_in_the_jvm_do_what_numpy_does(spark):
    m, kernel = context_mixing, context_mixing.kernel
    texts = [prose(i, n) for i, n in enumerate([400] * 8 + [1300, 700, 1, 0, 90])]
    model, code = trained(texts[:-1])
    texts.append([b"unheard-of", *prose(3, 40), b"unheard-of"])
    codes, per_doc = coded_words(code, texts)
    rows = [(b" ".join(t).upper(), i, False) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "text binary, doc_id long, held_out boolean").coalesce(1)
    loops, laid = m.loops(spark), m.laid_out(code)
    counts = np.zeros_like(model.counts)
    word, node, bit = m.bits_of(code, codes)
    for i, context in enumerate(m.word_contexts(codes, per_doc)):
        np.add.at(counts[i].reshape(-1), m.context_slots(context[word], node) * 2 + bit, 1)
    assert (m.summed_tables(kernel.mapped(loops, "count", docs, laid, "part long, own binary"), counts.shape, m.CUT) == counts).all()
    plain = m.Mixer(counts)
    laid |= {f"table{i}": t for i, t in enumerate(plain.left_out(code))} | {"weights": plain.weights.copy(), "refined": plain.refined.copy()}
    fitted = kernel.mapped(loops, "fit", docs, laid, "n long, weights binary, refined binary").collect()[0]
    assert fitted["n"] == m.fit(plain, code, codes, per_doc)
    assert np.frombuffer(fitted["weights"]).reshape(plain.weights.shape) / fitted["n"] == pytest.approx(plain.weights, abs=1e-4)
    assert np.frombuffer(fitted["refined"]) / fitted["n"] == pytest.approx(plain.refined, abs=1e-4)
    laid |= {f"table{i}": t for i, t in enumerate(plain.packed(code))} | {"weights": plain.weights, "refined": plain.refined}
    laid |= {"known": np.append(code.seen > 0, False), "base": np.append(code.seen + 0.5, 0.0)}
    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_bytes long, n_known long, base_score double, coded double, rare array<struct<word: binary, n: long>>"
    out = sorted(kernel.mapped(loops, "score", docs, laid, schema).collect(), key=lambda r: r["doc_id"])
    assert [r["coded"] for r in out] == pytest.approx(m.text_scores(plain, code, codes, per_doc).tolist(), rel=1e-4)
    assert [r["n_tokens"] for r in out] == per_doc.tolist() and out[-1]["n_known"] == 41
    assert [(bytes(w["word"]), w["n"]) for w in out[-1]["rare"]] == [(b"unheard-of", 2)] and not any(r["rare"] for r in out[:-1])


def test_speller_tables_come_from_few_tasks(spark, monkeypatch):
    words = spark.createDataFrame([(f"w{i}".encode(), 1) for i in range(300)], "word binary, count long")
    kind, seen, summed = type(words), [], context_mixing.summed_tables
    plain = kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda self, n, *by: plain(self, max(n, 21), *by))
    monkeypatch.setattr(context_mixing, "summed_tables", lambda rows, *more: seen.append(rows.rdd.getNumPartitions()) or summed(rows, *more))
    context_mixing.train_speller(words, 300)
    assert seen == [1]


# 2


def test_edits_and_fingerprints(spark):
    out = by_id(fingerprint.edit_report(documents(spark, extra=True)))
    order = sorted(TEXTS)
    for i, d in enumerate(order):
        text, after = TEXTS[d] or "", TEXTS[order[(i + 1) % len(order)]] or ""
        q = len(text) // 4
        assert out[d]["n_chars"] == len(text)
        assert out[d]["edited_sha256"] == hashlib.sha256((text[: len(text) - q] + after[:q]).encode()).hexdigest()
        assert 0 <= out[d]["near_edited"] <= 1 and 0 <= out[d]["near_next"] <= 1
    assert out[6]["fingerprint"] == out[7]["fingerprint"] != out[8]["fingerprint"]
    assert out[60]["near_edited"] > 0.6 > out[60]["near_next"]


def test_likeness_of_capitals_and_symbols(spark):
    drawn = random.Random(3)
    word = lambda: "".join(drawn.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    kinds = [lambda: word(), lambda: word().upper(), lambda: word() + drawn.choice(["$$$", "&&&", "%%%", "***"]), lambda: str(drawn.randrange(10**6)), lambda: "é" + word() + "ü"]
    table = [(i, " ".join(kinds[i % 5]() for _ in range(300)), None, None, 0) for i in range(20)]
    for r in fingerprint.edit_report(documents(spark, table=table)).collect():
        assert r["near_edited"] > 0.5 > r["near_next"], r["doc_id"]


def test_digest_lanes_are_independent(spark):
    """Hashes of one text under several lanes share no half, as they would if lanes were made from one 64-bit hash."""
    made = fingerprint.fingerprints(documents(spark, table=[(1, "one paragraph", None, None, 0)])).first()["fp"]["digests"]
    seeds = spark.range(1).select(*(F.xxhash64(F.lit(i), F.lit("one paragraph")).alias(f"h{i}") for i in range(4))).first()
    assert made == [h for s in seeds for h in (s & 0xFFFFFFFF, (s >> 32) & 0xFFFFFFFF)]


def test_fingerprints_add_up(spark):
    texts = {1: "alpha beta\ngamma delta one", 2: "gamma delta one\nalpha beta", 3: "alpha beta", 4: "gamma delta one"}
    df = fingerprint.fingerprints(documents(spark, table=[(i, t, None, None, 0) for i, t in texts.items()]))
    one = df.groupBy().pivot("doc_id", [1, 2, 3, 4]).agg(F.first("fp"))
    c = F.col
    r = one.select((c("1") == c("2")).alias("order"), (fingerprint.insert(c("3"), c("4")) == c("1")).alias("put_in"), (fingerprint.delete(c("1"), c("4")) == c("3")).alias("taken_out"), (c("1") == c("3")).alias("same")).first()
    assert (r["order"], r["put_in"], r["taken_out"], r["same"]) == (True, True, True, False)


# 3


def plain_components(texts, n=5, percent=80):
    sets = {}
    for i, t in texts.items():
        own = words((t or "").translate(LOWER))
        sets[i] = frozenset(tuple(own[k : k + n]) for k in range(max(1, len(own) - n + 1))) if own else frozenset()
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                shared = len(sets[a] & sets[b])
                if shared and 100 * shared >= percent * len(sets[a] | sets[b]) and label[a] > label[b]:
                    label[a], changed = label[b], True
    return {i: (len(sets[i]), label[i]) for i in sets}


def test_components(spark):
    out = by_id(jaccard_join.similar_components(documents(spark, extra=True)))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in out.items()} == plain_components(TEXTS)
    assert out[8]["component_id"] == 6 and out[5]["component_id"] == 4


def test_chains_of_near_copies(spark):
    base = [f"t{k}" for k in range(300)]
    texts = {}
    for i in range(40):
        base = list(base)
        base[(7 * i) % 300] = f"new{i}"
        texts[i] = " ".join(base)
    got = jaccard_join.similar_components(documents(spark, table=[(i, t, None, None, 0) for i, t in texts.items()]))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == plain_components(texts)
    kept = jaccard_join.one_of_each(documents(spark, table=[(i, t, None, None, 0) for i, t in texts.items()]))
    assert [r["doc_id"] for r in kept.collect()] == [0]


def test_links_are_all_counted(spark):
    base = sentence(3, 120).split()
    texts = dict(TEXTS)
    for i in range(150):  # near one another; every fifth far from some
        own = list(base)
        own[(11 * i) % 119] = f"new{i}"
        texts[1000 + i] = " ".join(own[: 120 - 4 * (i % 5)])
    texts[2000] = texts[1000]
    got = jaccard_join.similar_components(documents(spark, table=[(i, t, None, None, 0) for i, t in texts.items()]))
    sets = {}
    for i, t in texts.items():
        own = words((t or "").translate(LOWER))
        sets[i] = frozenset(tuple(own[k : k + 5]) for k in range(max(1, len(own) - 4))) if own else frozenset()
    distinct = set(sets.values()) - {frozenset()}
    want = {s: sum(100 * len(s & o) >= 80 * len(s | o) for o in distinct if o != s) for s in distinct}
    assert {r["doc_id"]: r["n_links"] for r in got.collect()} == {i: want.get(s, 0) for i, s in sets.items()}
    assert max(want.values()) > 50 and len(set(want.values())) > 5


def test_large_groups_of_near_copies_with_stragglers(spark):
    """Components above LARGE, documents that link with few of a component's, and others just short of a link."""
    drawn, texts = random.Random(1), {}
    for c, size in enumerate((60, 120, 200)):
        base = [f"c{c}w{i}" for i in range(size)]
        for _ in range(90):
            own = list(base)
            for _ in range(drawn.choice([0, 1, 2, 3, 4, 5, 6, 8])):
                own[drawn.randrange(size)] = f"x{drawn.randrange(10**9)}"
            texts[len(texts) * 7 % 271] = " ".join(own[: size - drawn.choice([0, 0, 5, 15])])
    got = {r["doc_id"]: r for r in jaccard_join.similar_components(documents(spark, table=[(i, t, None, None, 0) for i, t in texts.items()])).collect()}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == plain_components(texts)
    sets = {i: frozenset(tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)) for i, t in texts.items()}
    for i in texts:
        assert got[i]["n_links"] == sum(100 * len(sets[i] & s) >= 80 * len(sets[i] | s) for s in set(sets.values()) if s != sets[i])


def test_pairs_of_small_groups_are_not_a_row_per_gram(spark, monkeypatch):
    """40 pairs of classes that share 200 n-grams each: about a row per pair, whatever the tasks, and all n-grams counted."""
    monkeypatch.setattr(jaccard_join, "likely", lambda pairs, percent: pairs)
    groups = [(1000 * c + g, 2 * c + side, 1000, g, 200, 2 * c + side, 1) for c in range(40) for g in range(200) for side in (0, 1)]
    found = jaccard_join.cross_pairs(spark.createDataFrame(groups, "gram long, class long, n long, position long, matched long, label long, k long"), 80).collect()
    shared = collections.Counter()
    for r in found:
        shared[r["a"], r["b"]] += r["shared"]
    assert shared == {(2 * c, 2 * c + 1): 200 for c in range(40)} and len(found) <= 40 + 2 * 4  # a batch may end in a pair


# 4


def test_quality(spark):
    out = by_id(quality.quality(documents(spark, extra=True)))
    for i, t in TEXTS.items():
        own, text = words(t), t or ""
        windows = [tuple(own[k : k + 5]) for k in range(len(own) - 4)]
        count = collections.Counter(windows)
        covered = {k + j for k, w in enumerate(windows) if count[w] > 1 for j in range(5)}
        lines = [x for x in text.split("\n") if words(x)]
        failed = len(own) < 10 or 100 * len(covered) > 20 * len(own)
        r = out[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(own), sum(map(len, own)), sum(text.count(c) for c in "#*$%&|<>"))
        assert (r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (len(lines) - len(set(lines)), len(covered), failed)
        assert r["kept"] == (not failed)


def test_depleted_documents_go(spark):
    nav = "home about contact terms privacy imprint help search login\nall rights reserved by the owner of this very site"
    table = [(i, f"{nav}\n{'word ' * (i % 2)}", None, "h", 0) for i in range(20)] + [(100 + i, f"{nav}\n" + " ".join(f"u{i}v{k}" for k in range(90)), None, "h", 0) for i in range(10)]
    table += [(200, nav, None, "other", 0)]
    kept = {r["doc_id"] for r in quality.kept_documents(documents(spark, table=table), max_docs=5, max_share=0.1).collect()}
    assert kept == {0, 200, *range(100, 110)}


def test_quality_by_line_frequency(spark):
    """The verdict of the frequency branch, against a plain version, on rows that the base rules let through."""
    nav, foot = "Home about contact terms privacy imprint", "all rights reserved by the owner"
    table = [(i, f"{nav}\n  {foot.upper()} \n" + "\n".join(f"own{i}x{k} word{k}" for k in range(i % 12)), "en", "h", 0) for i in range(60)]
    table += [(100 + i, f"{nav} unique{i} and some more words to be kept here now", "en", "h", 0) for i in range(30)] + [(200, f"{nav}\n{foot}", "en", "g", 0), (201, table[7][1], "en", "h", 0), (202, None, None, "h", 0)]
    out = {r["doc_id"]: r for r in quality.quality(documents(spark, extra=True, table=table), max_docs=5, max_share=0.1).collect()}
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").lower()
    host, holders = collections.defaultdict(set), collections.defaultdict(dict)
    for i, text, _, source, _ in table:
        host[source].add(text or "")
        for line in (text or "").split("\n"):
            if words(line):
                holders[source, key(line)].setdefault(text, []).append(i)
    frequent = {k: min(min(v) for v in own.values()) for k, own in holders.items() if len(own) > 5 and len(own) > 0.1 * len(host[k[0]])}
    assert len(frequent) == 2
    for i, text, _, source, _ in table:
        gone = sum(len(words(x)) for x in (text or "").split("\n") if words(x) and frequent.get((source, key(x)), i) != i)
        n, r = len(words(text)), out[i]
        assert r["removed_words"] == gone
        assert r["kept"] == (not r["base_failed"] and not (gone and n - gone < 10 and n - gone < 0.2 * n))
    assert any(not r["kept"] and not r["base_failed"] for r in out.values()) and sum(r["kept"] for r in out.values()) > 30


def test_frequent_lines_are_taken_out_of_kept_documents(spark):
    nav = "Home about contact terms privacy"
    own = {i: " ".join(f"u{i}v{k}" for k in range(30)) for i in range(20)}
    table = [(i, f"  {nav.upper()} \n\n{own[i]}\n{nav}", "en", "h", 0) for i in range(20)] + [(50, f"{nav}\n{own[3]}", "en", "other", 0)]
    docs = documents(spark, extra=True, table=table)
    out = quality.kept_documents(docs, max_docs=5, max_share=0.1)
    assert out.columns == docs.columns
    want = {i: f"\n{own[i]}" for i in range(1, 20)} | {0: table[0][1], 50: table[20][1]}
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()} == {i: (t, len(t)) for i, t in want.items()}


# 5


def test_line_dedup(spark):
    docs = documents(spark, extra=True)
    out = by_id(line_dedup.kept_digests(docs, min_docs=10, min_chars=1))
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = collections.defaultdict(set)
    for i, t in TEXTS.items():
        for line in (t or "").split("\n"):
            holders[key(line)].add(i)
    for i, t in TEXTS.items():
        lines = (t or "").split("\n")
        stay = [x for x in lines if not key(x) or len(holders[key(x)]) < 10]
        assert (out[i]["n_lines"], out[i]["n_dropped"]) == (len(lines), len(lines) - len(stay))
        assert out[i]["kept_sha256"] == hashlib.sha256("\n".join(stay).encode()).hexdigest()
    left = line_dedup.without_repeated_lines(docs, min_docs=10)
    assert left.columns == docs.columns and left.count() == len(TEXTS)


def test_first_occurrences_stay_and_long_runs_are_cut(spark):
    table = [(i, "same line\nown %d" % i, None, None, 0) for i in range(300)]
    out = line_dedup.without_repeated_lines(documents(spark, table=table), min_docs=2, keep_first=True)
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts == {i: ("same line\n" if i == 0 else "") + f"own {i}" for i in range(300)}


# 6


def test_language_rules(spark):
    out = by_id(language_id.identified(documents(spark, extra=True)))
    for i, r in out.items():
        assert r["held_out"] == (fold(i, 4) == 2) and 0 <= r["score"] <= 1
    assert [out[i]["lang_pred"] for i in (1, 2, 3, 14)] == ["und"] * 4 and out[13]["lang_pred"] != "und"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    both = language_id.identified(docs).where("held_out").join(docs, "doc_id")
    assert both.where("lang = lang_pred").count() >= 0.97 * both.count()


def test_tables_equal_the_convolution():
    rng = np.random.default_rng(3)
    net = language_id.train([(bytes(rng.integers(97, 110, 600).tolist()), "a"), (bytes(rng.integers(105, 120, 600).tolist()), "b")], epochs=1)
    window = language_id.windows_of(bytes(rng.integers(97, 120, 512).tolist()))
    got = language_id.pooled(window, *net.tables())
    x, positions = window.astype(int), language_id.WINDOW - 3
    want = np.concatenate([sum(w[j][x[:, j : positions + j]] for j in range(len(w))).max(axis=1) for w in net.filters], axis=1)
    assert np.allclose(got, want, atol=1e-4)


# 7


def test_mix(spark):
    docs = documents(spark, extra=True)
    out = by_id(mixing.mix_plan(docs))
    again = by_id(mixing.mix_plan(docs.repartition(7)))
    size = {i: len(words(t)) for i, t in TEXTS.items()}
    source = {r[0]: r[3] for r in rows()}
    order = sorted(set(source.values()), key=lambda s: (s is None, s or ""))
    sizes = [sum(size[i] for i in size if source[i] == s) for s in order]
    want = dict(zip(order, mixing.targets(sizes, [(5, 2, 1)[k % 3] for k in range(len(order))], 1.5, 2.0)))
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes))
    for i, r in out.items():
        assert (r["size"], r["target"], r["taken"]) == (size[i], pytest.approx(want[source[i]]), again[i]["taken"])
        assert 0 <= r["taken"] <= 2 * size[i]
    for s, total in zip(order, sizes):
        taken = sum(r["taken"] for i, r in out.items() if source[i] == s)
        assert abs(taken - want[s]) <= max(64, 0.01 * want[s]) if total else taken == 0
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    got = collections.Counter()
    for r in mixed.collect():
        got[r["doc_id"]] += len(words(r["text"]))
    assert {i: got[i] for i in size} == {i: out[i]["taken"] for i in size}


def test_apportionment_against_the_one_by_one_rule():
    rng = np.random.default_rng(5)
    for _ in range(50):
        votes, seats = rng.integers(0, 1000, 8).tolist(), int(rng.integers(0, 60))
        held = [0] * 8
        for _ in range(seats if sum(votes) else 0):
            held[max(range(8), key=lambda i: (votes[i] / (2 * held[i] + 1), -i))] += 1
        assert mixing.apportion(votes, seats, [10**6] * 8) == held


# 8


def test_chat_round_trip(spark):
    turns = [(1, 0, "user", "a & <b> [INST] &lt; <|im_end|>\n"), (1, 1, "user", ""), (1, 2, "assistant", "x</s>"), (1, 2, "assistant", "tie"), (2, 5, None, None), (None, 0, "assistant", "no id"), (3, 0, "ro\nle", "t\n\n")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", *(f"1 AS `{c}`" for c in CLASHING), "'y' AS blocks", "'y' AS formatted")
    out = chat.format_conversations(df).withColumn("turns", chat.read_back(F.col("formatted")))
    got = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in out.collect()}
    want = collections.defaultdict(list)
    for conv, _, role, text in sorted(turns, key=lambda t: (str(t[0]), t[1], t[2] or "", t[3] or "")):
        want[conv].append((role or "", text or ""))
    assert got == want
    digests = {r["conv_id"]: r for r in chat.chat_digests(df).collect()}
    assert digests[1]["n_turns"] == 4 and digests[1]["loss_sha256"] == hashlib.sha256(b"tiex</s>").hexdigest() and digests[2]["loss_chars"] == 0
    assert "<b>" not in out.where("conv_id = 1").first()["formatted"] and len(out.where("conv_id = 1").first()["blocks"]) == 2


def test_loss_spans_point_into_the_output(spark):
    turns = [(c, i, ["user", "assistant", "assistant", "ro\nle<"][(c * 7 + i * i) % 4], f"t{c}.{i} <|im_sep|> & [x] 😀é\n" * (i % 3)) for c in range(6) for i in range(9)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    for r in chat.format_conversations(df).collect():
        parts = [r["formatted"][s["start"] : s["start"] + s["chars"]] for s in r["loss_spans"]]
        for mark, escaped in reversed(chat.ESCAPES):
            parts = [p.replace(escaped, mark) for p in parts]
        assert parts == [t for c, _, role, t in turns if c == r["conv_id"] and role == "assistant"]
    digests = {r["conv_id"]: r for r in chat.chat_digests(df).collect()}
    for c in range(6):
        want = "".join(t for k, _, role, t in turns if k == c and role == "assistant")
        assert (digests[c]["loss_chars"], digests[c]["loss_sha256"]) == (len(want), hashlib.sha256(want.encode()).hexdigest())


# 9


def test_shortcut_only_for_the_known_rules(tmp_path):
    from tokenizers import Tokenizer, pre_tokenizers

    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert packing.WordIds(public_tokenizers.path("word_bpe_49k.json")).plain
    coder.normalizer = None
    coder.save(str(tmp_path / "cased.json"))
    cased = packing.WordIds(str(tmp_path / "cased.json"))
    assert not cased.plain and cased.encode([b"House"]) == [coder.encode("House", add_special_tokens=False).ids] != cased.encode([b"house"])
    coder.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    coder.save(str(tmp_path / "spaced.json"))
    with pytest.raises(ValueError, match="white space"):
        packing.WordIds(str(tmp_path / "spaced.json"))


def test_packing_worker_remembers_few_words(monkeypatch):
    monkeypatch.setattr(packing, "KNOWN_WORDS", 100)
    coder = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    for call in range(8):
        texts = ["the", "Weiß,", "x-1", *(f"w{call}q{i}" for i in range(60)), "the", "", "日本"]
        ids, counts = coder.ids(pa.array([t.encode() for t in texts], pa.binary()))
        assert len(coder.words) <= 100
        want = [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert b"the" in coder.words.to_pylist()
    ids, counts = coder.ids(pa.array([], pa.binary()))
    assert not len(ids) and not len(counts)


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = TEXTS | {70: "<|endoftext|> <|ENDOFTEXT|> don't WON'T H̱ ok.", 71: "a\x1cb\x85c d"}
    table = [r for r in rows()] + [(i, texts[i], None, None, 0) for i in (70, 71)]
    pieces = packing.pack(documents(spark, extra=True, table=table), window=512).collect()
    ids = {i: coder.encode(t or "", add_special_tokens=False).ids + [2] for i, t in texts.items()}
    seen, filled = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        own = ids[p["doc_id"]]
        assert p["doc_tokens"] == len(own) and p["length"] > 0
        assert p["ids_crc32"] == zlib.crc32(np.array(own[p["start"] : p["start"] + p["length"]], "<u4").tobytes())
        seen[p["doc_id"]].append((p["start"], p["length"]))
        filled[p["sequence_id"]].append((p["offset"], p["length"]))
    for parts, whole in [(seen[i], len(own)) for i, own in ids.items()] + [(f, None) for f in filled.values()]:
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == whole if whole is not None else at <= 512


def test_windows_are_near_equal():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 2048, 1000)
    sums = np.bincount(packing.windows(lengths, 4096), lengths)
    assert sums.max() <= 4096 and lengths.sum() / (4096 * len(sums)) > 0.97


# 10


def test_token_counts_against_plain_search(spark):
    vocabulary = token_counts.Vocabulary(public_tokenizers.path("piece_bpe_32k.model"))

    def best(word):
        found = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            size = len(word[end - 1].encode())
            options = [(found[end - 1][0] + size * token_counts.BYTE_SCORE, found[end - 1][1] + size)]
            options += [(found[s][0] + vocabulary.scores[word[s:end]], found[s][1] + 1) for s in range(max(0, end - vocabulary.longest), end) if word[s:end] in vocabulary.scores]
            found.append(max(options, key=lambda o: (o[0], -o[1])))
        return found[-1]

    out = by_id(token_counts.token_counts(documents(spark, extra=True)))
    for i, t in TEXTS.items():
        costs = [best("▁" + w) for w in words(t)]
        assert (out[i]["n_pretokens"], out[i]["n_tokens"]) == (len(costs), sum(c[1] for c in costs))
        assert out[i]["score"] == pytest.approx(sum(c[0] for c in costs))


def test_terminals_do_not_depend_on_what_the_trie_remembers(monkeypatch):
    vocabulary = token_counts.Vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    tokens = ["▁" + w for t in TEXTS.values() for w in words(t)][:3000] + ["▁" + "abcé" * 3000]

    def terminals():
        trie = token_counts.Trie(vocabulary)
        numbers = [trie.insert(t) for t in tokens]
        return [(trie.terminal_scores[i], trie.terminal_counts[i]) for i in numbers], len(trie.score)

    whole, _ = terminals()
    monkeypatch.setattr(token_counts, "KNOWN_NODES", 50)
    monkeypatch.setattr(token_counts, "LONG", 100)
    pruned, nodes = terminals()
    assert pruned == whole and nodes <= 150


# All


OPERATORS = [context_mixing.score, fingerprint.edit_report, jaccard_join.similar_components, quality.quality, line_dedup.kept_digests, language_id.identified, mixing.mix_plan, packing.pack, token_counts.token_counts, jaccard_join.one_of_each, quality.kept_documents, line_dedup.without_repeated_lines, mixing.mix]


@pytest.mark.parametrize("operator", OPERATORS, ids=lambda f: f"{f.__module__.rsplit('.', 1)[-1]}.{f.__name__}")
def test_empty_tables_and_repeated_or_null_ids(spark, operator):
    assert operator(spark.createDataFrame([], DOCS)).count() == 0
    odd = [(None, None, None, None, None), (None, "null id with some words in it to be kept here", None, None, 1), (7, "twice the same row of more than ten words so that it stays", "en", "a", 1), (7, "twice the same row of more than ten words so that it stays", "en", "a", 1), (7, "other text", "en", "a", 1)]
    assert operator(documents(spark, table=odd)).count() >= 1
