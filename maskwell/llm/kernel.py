"""The loops of `context_mixing` over running text in the JVM: what its numpy versions do, choice by choice.

Spark's own run-time compiler (Janino, which makes its generated code) compiles the source on the driver; the classes go
to the executors in a small jar, the model in a broadcast. Where that compiler is missing, numpy does the same work at
several times the CPU seconds; results differ by rounding alone.
"""

from __future__ import annotations

import functools
import hashlib
import os
import tempfile
import warnings
import weakref
import zipfile

import numpy as np
from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Logarithms of a document's own counts, with the fifth that stretching adds.
LOGARITHMS = np.log(np.arange(1 << 12, dtype=np.float32) + np.float32(0.2))

SOURCE = r"""
package maskwell;

import java.nio.ByteBuffer;
import java.nio.ByteOrder;
import java.nio.file.Files;
import java.nio.file.Paths;
import java.util.ArrayList;
import java.util.Arrays;
import java.util.Comparator;
import java.util.HashMap;
import java.util.Iterator;
import java.util.Map;
import org.apache.spark.TaskContext;
import org.apache.spark.api.java.function.MapPartitionsFunction;
import org.apache.spark.broadcast.Broadcast;
import org.apache.spark.sql.Row;
import org.apache.spark.sql.RowFactory;

public class @NAME@ implements MapPartitionsFunction {
@CONSTANTS@
    /** The model that this process read last. */
    private static Model last;

    private String task;
    private Broadcast model;
    private transient HashMap parts = new HashMap();

    /** On the driver: a part of the model, from a file. */
    public void put(String name, String path) throws Exception {
        parts.put(name, Files.readAllBytes(Paths.get(path, new String[0])));
    }

    public HashMap parts() {
        return parts;
    }

    public void set(String task, Broadcast model) {
        this.task = task;
        this.model = model;
        this.parts = null;
    }

    /** Tasks of an executor share the model, which they only read. */
    private static synchronized Model of(Map parts) {
        if (last == null || last.parts != parts) last = new Model(parts);
        return last;
    }

    public Iterator call(Iterator rows) throws Exception {
        Work work = new Work(of((Map) model.value()));
        if (task.equals("count")) return work.counted(rows);
        if (task.equals("fit")) return work.fitted(rows);
        return work.scored(rows);
    }

    /** The code of the common words, the packed tables of orders 0 to 2, weights and refinement to start from. */
    static final class Model {
        final Map parts;
        final byte[] words, sizes;
        final int[] offsets, start, path, slots, tags;
        final char[][] tables = new char[3][];
        final float[] logs, weights, refined;
        final double[] base;
        final byte[] known;
        final int escape, end, shift, longest;

        Model(Map parts) {
            this.parts = parts;
            words = (byte[]) parts.get("words");
            sizes = (byte[]) parts.get("sizes");
            known = (byte[]) parts.get("known");
            offsets = ints("offsets");
            path = ints("path");
            logs = floats("logs");
            weights = floats("weights");
            refined = floats("refined");
            for (int i = 0; i < 3; i++) {
                ByteBuffer b = buffer("table" + i);
                tables[i] = new char[b.remaining() / 2];
                b.asCharBuffer().get(tables[i]);
            }
            ByteBuffer b = buffer("base");
            base = new double[b.remaining() / 8];
            b.asDoubleBuffer().get(base);
            escape = offsets.length - 1;
            start = new int[sizes.length];
            int most = 0;
            for (int i = 0; i < sizes.length; i++) {
                if (i > 0) start[i] = start[i - 1] + sizes[i - 1];
                most = Math.max(most, sizes[i]);
            }
            longest = most;
            int bits = 4;
            while ((1 << bits) < 2 * escape + 2) bits++;
            shift = 64 - bits;
            slots = new int[1 << bits];
            tags = new int[1 << bits];
            Arrays.fill(slots, -1);
            int empty = -1;
            for (int i = 0; i < escape; i++) {
                if (offsets[i] == offsets[i + 1]) {
                    empty = i;
                    continue;
                }
                long h = 0;
                for (int j = offsets[i]; j < offsets[i + 1]; j++) h = (h ^ words[j]) * PRIME;
                int at = (int) ((h * SPREAD) >>> shift);
                while (slots[at] >= 0) at = (at + 1) & (slots.length - 1);
                slots[at] = i;
                tags[at] = (int) h;
            }
            end = empty;
        }

        private ByteBuffer buffer(String name) {
            byte[] b = (byte[]) parts.get(name);
            return ByteBuffer.wrap(b == null ? new byte[0] : b).order(ByteOrder.LITTLE_ENDIAN);
        }

        private int[] ints(String name) {
            ByteBuffer b = buffer(name);
            int[] out = new int[b.remaining() / 4];
            b.asIntBuffer().get(out);
            return out;
        }

        private float[] floats(String name) {
            ByteBuffer b = buffer(name);
            float[] out = new float[b.remaining() / 4];
            b.asFloatBuffer().get(out);
            return out;
        }

        /** The code of text[from:to], whose hash is h. */
        int find(byte[] text, int from, int to, long h) {
            int at = (int) ((h * SPREAD) >>> shift), tag = (int) h, n = to - from;
            for (int i = slots[at]; i >= 0; i = slots[at]) {
                if (tags[at] == tag && offsets[i + 1] - offsets[i] == n) {
                    int j = 0, o = offsets[i];
                    while (j < n && words[o + j] == text[from + j]) j++;
                    if (j == n) return i;
                }
                at = (at + 1) & (slots.length - 1);
            }
            return escape;
        }

        float logarithm(int n) {
            return n < logs.length ? logs[n] : (float) Math.log(n + 0.2f);
        }

        float stretched(int n0, int n1) {
            if ((n0 | n1) < 4096) return logs[n1] - logs[n0];  // within 10 of zero
            float r = logarithm(n1) - logarithm(n0);
            return r < -10f ? -10f : r > 10f ? 10f : r;
        }
    }

    static long hashed(long h, long before, long back) {
        h = (h + before + back) * 0x9E3779B97F4A7C15L;
        return h ^ (h >>> 31);
    }

    /** 1 / (1 + exp(-z)) from -8 to 8 in steps of 1/256; a line between two is right to 2e-7. */
    static final float[] SQUASHED = new float[4098];

    static {
        for (int i = 0; i < SQUASHED.length; i++) SQUASHED[i] = (float) (1 / (1 + Math.exp(8 - i / 256.0)));
    }

    /** Weights and refinement, and what the choices since they last followed say. */
    static final class State {
        final float[] weights = new float[GATES * INPUTS], slope = new float[GATES * INPUTS], refined = new float[BINS];
        final int[] seen = new int[GATES], hits = new int[BINS], ones = new int[BINS];

        void begin(Model m) {
            for (int g = 0; g < GATES; g++) for (int i = 0; i < INPUTS; i++) weights[g * INPUTS + i] = m.weights[i * GATES + g];
            System.arraycopy(m.refined, 0, refined, 0, BINS);
        }

        /** The taken bit's probability, if wanted; what the choice says is kept for follow(). */
        float choose(float x0, float x1, float x2, float x3, float x4, int gate, int bit, boolean wanted) {
            int g = gate * INPUTS;
            float z = x0 * weights[g] + x1 * weights[g + 1] + x2 * weights[g + 2] + x3 * weights[g + 3] + x4 * weights[g + 4];
            z = (z < -7.99f ? -7.99f : z > 7.99f ? 7.99f : z) + 8f;
            float fine = z * 256f;
            int step = (int) fine;
            float p = SQUASHED[step] + (fine - step) * (SQUASHED[step + 1] - SQUASHED[step]);
            float spot = z * ((BINS - 1) / 16f);
            int low = (int) spot;
            float part = spot - low, error = bit - p;
            float q = wanted ? refined[low] + part * (refined[low + 1] - refined[low]) : 0f;
            slope[g] += x0 * error;
            slope[g + 1] += x1 * error;
            slope[g + 2] += x2 * error;
            slope[g + 3] += x3 * error;
            slope[g + 4] += x4 * error;
            seen[gate]++;
            if (part > 0.5f) low++;
            hits[low]++;
            ones[low] += bit;
            if (!wanted) return 0f;
            p = (p + q) * 0.5f;
            p = p < 1e-5f ? 1e-5f : p > 0.99999f ? 0.99999f : p;
            return bit == 1 ? p : 1f - p;
        }

        void follow() {
            for (int g = 0; g < GATES; g++) {
                if (seen[g] > 0) {
                    float scale = (float) (RATE / Math.sqrt(seen[g]));
                    for (int i = g * INPUTS; i < (g + 1) * INPUTS; i++) {
                        weights[i] += scale * slope[i];
                        slope[i] = 0f;
                    }
                    seen[g] = 0;
                }
            }
            for (int b = 0; b < BINS; b++) {
                if (hits[b] > 0) {
                    float n = hits[b];
                    refined[b] += (ones[b] - n * refined[b]) * Math.min(0.5f / n, 1f / (n + 400f));
                    hits[b] = 0;
                    ones[b] = 0;
                }
            }
        }
    }

    /** What one task holds. */
    static final class Work {
        final Model m;
        final State s = new State();
        int[] codes = new int[1024], spots = new int[1024], own = new int[0];
        byte[] low = new byte[1024];
        int nSpots;
        HashMap rare;

        Work(Model m) {
            this.m = m;
        }

        /** Codes of a text's words, A-Z lower-cased, and its end; their number. Escaped words are counted in `rare`, if it is there. */
        int coded(byte[] text) {
            int n = 0, from = 0;
            if (low.length < text.length) low = new byte[text.length];
            long h = 0;
            for (int i = 0; i <= text.length; i++) {
                byte c = i < text.length ? text[i] : (byte) 32;
                if (c == 32 || (c >= 9 && c <= 13)) {
                    if (i > from) {
                        if (n + 2 > codes.length) codes = Arrays.copyOf(codes, Math.max(n + 2, (int) Math.min(2147483000L, 2L * codes.length)));
                        int code = m.find(low, from, i, h);
                        codes[n++] = code;
                        if (code == m.escape && rare != null) {
                            ByteBuffer word = ByteBuffer.wrap(Arrays.copyOfRange(low, from, i));
                            long[] seen = (long[]) rare.get(word);
                            if (seen == null) rare.put(word, new long[] {1L});
                            else seen[0]++;
                        }
                    }
                    from = i + 1;
                    h = 0;
                } else {
                    if (c >= 65 && c <= 90) c += 32;
                    low[i] = c;
                    h = (h ^ c) * PRIME;
                }
            }
            codes[n++] = m.end;
            return n;
        }

        static long one(int[] codes, int w) {
            return hashed(0L, w > 0 ? codes[w - 1] + 1L : 0L, 1L);
        }

        static long two(int[] codes, int w, long one) {
            return hashed(one, w > 1 ? codes[w - 2] + 1L : 0L, 2L);
        }

        static int block(int at) {
            return at < LONG_AFTER ? BLOCK : LONG_BLOCK;
        }

        int room(int[] codes, int n) {
            long bits = 0;
            for (int w = 0; w < n; w++) bits += m.sizes[codes[w]];
            return 1 << Math.min(OWN_BITS, 63 - Long.numberOfLeadingZeros(Math.max(2L, bits)));
        }

        void reserve(long choices) {
            if (spots.length < 2 * choices) spots = new int[(int) (2 * choices)];
        }

        Iterator counted(Iterator rows) {
            int[][] counts = new int[2][2 << CONTEXT_BITS];
            int[] first = counts[0], second = counts[1];
            while (rows.hasNext()) {
                int n = coded((byte[]) ((Row) rows.next()).get(0));
                for (int w = 0; w < n; w++) {
                    long h = one(codes, w), one = h * SPREAD, two = two(codes, w, h) * SPREAD;
                    for (int j = m.start[codes[w]], to = j + m.sizes[codes[w]]; j < to; j++) {
                        int choice = m.path[j];
                        long spread = (choice >>> 1) * SPREAD;
                        first[(int) ((one + spread) >>> (64 - CONTEXT_BITS)) * 2 + (choice & 1)]++;
                        second[(int) ((two + spread) >>> (64 - CONTEXT_BITS)) * 2 + (choice & 1)]++;
                    }
                }
            }
            return new Pieces(counts);
        }

        /** Runs words [at, stop) of a text through the mixer; its own tables start at 2 * alone and 2 * after. Returns log10 of the
            probability; with leftOut, training counts leave out one sight of each choice, and weights follow after each of `parts`. */
        double run(int[] codes, int at, int stop, int alone, int after, int mask, boolean leftOut, Parts parts) {
            double total = 0, product = 1;
            char[] t0 = m.tables[0], t1 = m.tables[1], t2 = m.tables[2];
            int[] own = this.own, spots = this.spots;
            int spot = nSpots;
            for (int w = at; w < stop; w++) {
                long h = one(codes, w), one = h * SPREAD, two = two(codes, w, h) * SPREAD;
                for (int j = m.start[codes[w]], to = j + m.sizes[codes[w]]; j < to; j++) {
                    int choice = m.path[j], node = choice >>> 1, bit = choice & 1;
                    long spread = node * SPREAD;
                    int s0 = node, s1 = (int) ((one + spread) >>> (64 - CONTEXT_BITS)), s2 = (int) ((two + spread) >>> (64 - CONTEXT_BITS));
                    int a = 2 * (alone + ((int) ((node * 0x9E3779B1L) >>> 7) & mask)), b = 2 * (after + (s1 & mask));
                    if (leftOut) {
                        s0 = choice;
                        s1 = 2 * s1 + bit;
                        s2 = 2 * s2 + bit;
                    }
                    int e0 = t0[s0], e1 = t1[s1], e2 = t2[s2];
                    float p = s.choose((e0 >>> 2) * (1f / 800) - 10f, (e1 >>> 2) * (1f / 800) - 10f, (e2 >>> 2) * (1f / 800) - 10f,
                        m.stretched(own[a], own[a + 1]), m.stretched(own[b], own[b + 1]), (e1 & 3) + SEEN * (e2 & 3), bit, !leftOut);
                    spots[spot++] = a + bit;
                    spots[spot++] = b + bit;
                    if (leftOut) {
                        parts.took();
                    } else {
                        product *= p;
                        if (product < 1e-250) {
                            total += Math.log10(product);
                            product = 1;
                        }
                    }
                }
            }
            nSpots = spot;
            return total + Math.log10(product);
        }

        /** The choices since the last time enter the texts' own counts. */
        void enter() {
            for (int i = 0; i < nSpots; i++) own[spots[i]]++;
            nSpots = 0;
        }

        /** When weights follow: after equal parts of n choices, FIT_BITS at most. */
        final class Parts {
            long n, parts, part, done, next;

            void over(long choices) {
                n = choices;
                parts = (n + FIT_BITS - 1) / FIT_BITS;
                part = 1;
                done = 0;
                next = n / Math.max(1, parts);
            }

            void took() {
                if (++done == next) {
                    s.follow();
                    next = n * ++part / parts;
                }
            }
        }

        double score(int n) {
            int room = room(codes, n);
            if (own.length < 4 * room) own = new int[4 * room];
            else Arrays.fill(own, 0, 4 * room, 0);
            s.begin(m);
            reserve((long) LONG_BLOCK * m.longest);
            double total = 0;
            for (int at = 0; at < n; at += block(at)) {
                total += run(codes, at, Math.min(n, at + block(at)), 0, room, room - 1, false, null);
                enter();
                s.follow();
            }
            return total;
        }

        Iterator fitted(Iterator rows) {
            s.begin(m);
            long n = 0, words = 0, bytes = 0;
            ArrayList texts = new ArrayList();
            while (rows.hasNext()) {
                byte[] text = (byte[]) ((Row) rows.next()).get(0);
                int size = coded(text);
                boolean full = bytes + text.length > CHUNK;  // weights depend on where a group ends, so it ends as numpy's does
                bytes = full ? text.length : bytes + text.length;
                if (full || words + size > ABREAST) {
                    n += fit(texts);
                    texts.clear();
                    words = 0;
                }
                texts.add(Arrays.copyOf(codes, size));
                words += size;
            }
            n += fit(texts);
            ByteBuffer w = ByteBuffer.allocate(8 * INPUTS * GATES).order(ByteOrder.LITTLE_ENDIAN), r = ByteBuffer.allocate(8 * BINS).order(ByteOrder.LITTLE_ENDIAN);
            for (int i = 0; i < INPUTS; i++) for (int g = 0; g < GATES; g++) w.putDouble(n * (double) s.weights[g * INPUTS + i]);
            for (int b = 0; b < BINS; b++) r.putDouble(n * (double) s.refined[b]);
            ArrayList out = new ArrayList();
            out.add(RowFactory.create(new Object[] {Long.valueOf(n), w.array(), r.array()}));
            return out.iterator();
        }

        /** Weights and refinement follow the texts, longest first, side by side, SLICE words at a time; the number of choices. */
        long fit(ArrayList texts) {
            int docs = texts.size(), active = docs;
            int[][] text = (int[][]) texts.toArray(new int[docs][]);
            Arrays.sort(text, new Comparator() {
                public int compare(Object a, Object b) {
                    return Integer.compare(((int[]) b).length, ((int[]) a).length);
                }
            });
            int[] first = new int[docs + 1];
            for (int d = 0; d < docs; d++) first[d + 1] = first[d] + room(text[d], text[d].length);
            int slots = first[docs];
            if (own.length < 4 * slots) own = new int[4 * slots];
            else Arrays.fill(own, 0, 4 * slots, 0);
            reserve((long) Math.max(SLICE, LONG_BLOCK) * m.longest);
            Parts parts = new Parts();
            long all = 0;
            for (int at = 0; docs > 0 && at < text[0].length; at += block(at)) {
                while (text[active - 1].length <= at) active--;
                for (int low = 0, high = 0; low < active; low = high) {
                    int words = 0;
                    long n = 0;
                    for (high = low; high < active; high++) {
                        int stop = Math.min(text[high].length, at + block(at));
                        if (high > low && words + stop - at > SLICE) break;
                        words += stop - at;
                        for (int w = at; w < stop; w++) n += m.sizes[text[high][w]];
                    }
                    parts.over(n);
                    for (int d = low; d < high; d++) run(text[d], at, Math.min(text[d].length, at + block(at)), first[d], slots + first[d], first[d + 1] - first[d] - 1, true, parts);
                    enter();
                    all += n;
                }
            }
            return all;
        }

        Iterator scored(final Iterator rows) {
            return new Iterator() {
                long number = (long) TaskContext.getPartitionId() << 33;

                public boolean hasNext() {
                    return rows.hasNext();
                }

                public Object next() {
                    Row row = (Row) rows.next();
                    byte[] text = (byte[]) row.get(0);
                    rare = new HashMap();
                    int n = coded(text);
                    long known = 0;
                    double base = 0;
                    for (int w = 0; w < n; w++) {
                        known += m.known[codes[w]];
                        base += m.base[codes[w]];
                    }
                    Object[] words = new Object[rare.size()];
                    int at = 0;
                    for (Iterator each = rare.entrySet().iterator(); each.hasNext(); ) {
                        Map.Entry e = (Map.Entry) each.next();
                        words[at++] = RowFactory.create(new Object[] {((ByteBuffer) e.getKey()).array(), Long.valueOf(((long[]) e.getValue())[0])});
                    }
                    return RowFactory.create(new Object[] {Long.valueOf(number++), row.get(1), row.get(2), Long.valueOf(n), Long.valueOf(text.length), Long.valueOf(known), Double.valueOf(base), Double.valueOf(score(n)), words});
                }

                public void remove() {
                    throw new UnsupportedOperationException();
                }
            };
        }
    }

    /** The pieces of both tables that hold anything, CUT numbers each. */
    static final class Pieces implements Iterator {
        final int[][] counts;
        int at = -1;

        Pieces(int[][] counts) {
            this.counts = counts;
            ahead();
        }

        private int each() {
            return counts[0].length / CUT;
        }

        private void ahead() {
            for (at++; at < 2 * each(); at++) {
                int[] t = counts[at / each()];
                for (int i = at % each() * CUT, to = i + CUT; i < to; i++) if (t[i] != 0) return;
            }
        }

        public boolean hasNext() {
            return at < 2 * each();
        }

        public Object next() {
            ByteBuffer b = ByteBuffer.allocate(4 * CUT).order(ByteOrder.LITTLE_ENDIAN);
            b.asIntBuffer().put(counts[at / each()], at % each() * CUT, CUT);
            Object row = RowFactory.create(new Object[] {Long.valueOf(at), b.array()});
            ahead();
            return row;
        }

        public void remove() {
            throw new UnsupportedOperationException();
        }
    }
}
"""

_sent: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


@functools.cache
def source(constants: tuple[tuple[str, int | float], ...]) -> tuple[str, str]:
    """Name and source of the class for these constants."""
    lines = "\n".join(f"    static final {'double' if isinstance(v, float) else 'long' if abs(v) >> 31 else 'int'} {k} = {v}{'L' if not isinstance(v, float) and abs(v) >> 31 else ''};" for k, v in constants)
    name = "Loops" + hashlib.sha256((SOURCE + lines).encode()).hexdigest()[:12]
    return name, SOURCE.replace("@NAME@", name).replace("@CONSTANTS@", lines)


def loops(spark: SparkSession, constants: tuple[tuple[str, int | float], ...]) -> JavaObject | None:
    """The compiled class, which the executors have too, or None if this Spark has no compiler."""
    context = spark.sparkContext
    name, text = source(constants)
    sent = _sent.setdefault(context, {})
    if name not in sent:
        try:
            compiler = context._jvm.org.codehaus.janino.SimpleCompiler()
            compiler.cook(text)
            kind, classes = compiler.getClassLoader().loadClass(f"maskwell.{name}"), dict(compiler.getBytecodes())
        except (Py4JError, TypeError) as error:
            warnings.warn(f"context mixing runs in numpy, as its loops did not compile: {error}", stacklevel=2)
            kind, classes = None, {}
        if kind is not None:
            jar = os.path.join(tempfile.mkdtemp(prefix="loops-"), f"{name}.jar")
            with zipfile.ZipFile(jar, "w") as z:
                for own, code in classes.items():
                    z.writestr(own.replace(".", "/") + ".class", bytes(code))
            context._jsc.addJar(jar)
        sent[name] = kind
    return sent[name]


def mapped(kind: JavaObject, task: str, rows: DataFrame, model: dict[str, np.ndarray | bytes], schema: str) -> DataFrame:
    """What the class's `task` makes of each partition of `rows`, whose first column is the text as binary."""
    spark = rows.sparkSession
    own = kind.newInstance()
    with tempfile.TemporaryDirectory() as folder:
        for name, values in model.items():
            with open(f"{folder}/{name}", "wb") as f:
                f.write(values if isinstance(values, bytes) else np.ascontiguousarray(values).data)
            own.put(name, f"{folder}/{name}")
    own.set(task, spark.sparkContext._jsc.broadcast(own.parts()))
    as_java = spark._jsparkSession.parseDataType(StructType.fromDDL(schema).json())
    return DataFrame(rows._jdf.mapPartitions(own, spark._jvm.org.apache.spark.sql.Encoders.row(as_java)), spark)
