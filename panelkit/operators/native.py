"""The loops of ``boosting`` in Java, for the executors' own virtual machines.

Janino, the compiler that Spark brings for its generated code, compiles them once an application; the classes go to the
executors as a jar.  Tasks pack a block of rows into bytes and the function that ``trees`` registers
grows its trees.  Sums are taken in numpy's order, so that trees and forecasts are those of ``boosting.grow`` to the bit.
Without a virtual machine at hand (Spark Connect) there is no function and the tasks go on in numpy.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import zipfile
from atexit import register

import numpy as np
from pyspark.sql import SparkSession

NAME = "panelkit_trees"
#: Of a packed block: forecasts of other rows, or sums over its own rows of the features' absolute Shapley values.
FORECAST, EXPLAIN = 0, 1

SOURCE = r"""
package panelkit;

import java.nio.ByteBuffer;
import java.nio.ByteOrder;

public final class Trees implements org.apache.spark.sql.api.java.UDF1 {
    private static final long serialVersionUID = 1L;

    public Object call(Object packed) {
        return packed == null ? null : new Work(ByteBuffer.wrap((byte[]) packed).order(ByteOrder.LITTLE_ENDIAN)).result();
    }

    private static final class Work {
        final int kind, n, width, bins, depth, minRows, groups, rounds, asked;
        final double rate;
        final short[] codes, askedCodes;
        final int[] group, askedGroup;
        final double[] target, level;
        final byte[] used;
        // one tree by heap node, and what growing it needs
        final int words;
        final int[] feature, cut, rows, moved, place;
        final double[] value, cover, rest, cells, sums, counts;
        final long[] held;
        // one path of a tree, and the table of its leaf
        int[] low, high, names;
        boolean[] met;
        double[] share, sizes, weight, table, shapley;
        int[] own;

        Work(ByteBuffer b) {
            kind = b.getInt();
            n = b.getInt();
            width = b.getInt();
            bins = b.getInt();
            depth = b.getInt();
            minRows = b.getInt();
            groups = b.getInt();
            rounds = b.getInt();
            asked = b.getInt();
            rate = b.getDouble();
            target = new double[n];
            level = new double[groups];
            group = new int[n];
            askedGroup = new int[asked];
            codes = new short[n * width];
            askedCodes = new short[asked * width];
            used = new byte[rounds * ((n + 7) / 8)];
            for (int i = 0; i < n; i++) target[i] = b.getDouble();
            for (int i = 0; i < groups; i++) level[i] = b.getDouble();
            for (int i = 0; i < n; i++) group[i] = b.getInt();
            for (int i = 0; i < asked; i++) askedGroup[i] = b.getInt();
            for (int i = 0; i < codes.length; i++) codes[i] = b.getShort();
            for (int i = 0; i < askedCodes.length; i++) askedCodes[i] = b.getShort();
            b.get(used);
            int nodes = (1 << (depth + 1)) - 1;
            feature = new int[nodes];
            cut = new int[nodes];
            value = new double[nodes];
            cover = new double[nodes];
            rest = new double[n];
            rows = new int[n + 1];
            moved = new int[n + 1];
            cells = new double[2 * width * bins];
            words = (bins + 63) / 64;
            held = new long[width * words];
            place = new int[bins];
            sums = new double[bins];
            counts = new double[bins];
        }

        /** A node of the drawn rows from..to, which are in ascending order; its histogram decides the split. */
        void build(int from, int to, int node, int at) {
            int m = to - from, best = -1;
            cover[node] = m;
            feature[node] = -1;
            value[node] = 0;
            if (at < depth && m >= 2 * minRows) {
                for (int i = from; i < to; i++) {
                    int row = rows[i], first = row * width;
                    double r = rest[row];
                    for (int f = 0; f < width; f++) {
                        int code = codes[first + f], c = 2 * (f * bins + code);
                        cells[c] += r;
                        cells[c + 1]++;
                        held[f * words + (code >> 6)] |= 1L << code;
                    }
                }
                double most = 0;
                boolean undefined = false;
                for (int f = 0; f < width; f++) {
                    // bins with rows only: others change no sum
                    int places = 0;
                    double both = 0;
                    for (int w = 0; w < words; w++) {
                        long bits = held[f * words + w];
                        held[f * words + w] = 0;
                        for (; bits != 0; bits &= bits - 1) {
                            int b = w * 64 + Long.numberOfTrailingZeros(bits), c = 2 * (f * bins + b);
                            place[places] = b;
                            sums[places] = cells[c];
                            counts[places++] = cells[c + 1];
                            both += cells[c];
                            cells[c] = 0;
                            cells[c + 1] = 0;
                        }
                    }
                    double whole = both * both / m, a = 0, left = 0;
                    for (int i = 0; i < places; i++) {
                        a += sums[i];
                        left += counts[i];
                        if (left < minRows) continue;
                        if (left > m - minRows) break;
                        double gain = a * a / left + (both - a) * (both - a) / (m - left) - whole;
                        if (gain != gain) undefined = true;
                        if (gain > most) {
                            most = gain;
                            best = f * bins + place[i];
                        }
                    }
                }
                if (undefined) best = -1;
            }
            if (best < 0) {
                double total = 0;
                for (int i = from; i < to; i++) total += rest[rows[i]];
                value[node] = rate * total / (m > 1 ? m : 1);
                return;
            }
            int f = best / bins, last = best % bins, left = from, right = 0;
            feature[node] = f;
            cut[node] = last;
            for (int i = from; i < to; i++) {
                int row = rows[i];
                if (codes[row * width + f] > last) moved[right++] = row;
                else rows[left++] = row;
            }
            System.arraycopy(moved, 0, rows, left, right);
            build(from, left, 2 * node + 1, at + 1);
            build(left, to, 2 * node + 2, at + 1);
        }

        double leaf(short[] of, int first) {
            int node = 0;
            while (feature[node] >= 0) node = 2 * node + 1 + (of[first + feature[node]] > cut[node] ? 1 : 0);
            return value[node];
        }

        /** Rows by group, each in ascending order: those of group g stand from first[g] to first[g + 1]. */
        static int[][] byGroup(int[] group, int groups) {
            int[] first = new int[groups + 1], order = new int[group.length], next = new int[groups];
            for (int i = 0; i < group.length; i++) first[group[i] + 1]++;
            for (int g = 0; g < groups; g++) first[g + 1] += first[g];
            System.arraycopy(first, 0, next, 0, groups);
            for (int i = 0; i < group.length; i++) order[next[group[i]]++] = i;
            return new int[][] {first, order};
        }

        double[] result() {
            int[][] known = byGroup(group, groups), wanted = byGroup(askedGroup, groups);
            int[] first = known[0], order = known[1], firstAsked = wanted[0], orderAsked = wanted[1];
            double[] fitted = new double[n], out = new double[kind == 0 ? asked : groups * width];
            for (int i = 0; i < n; i++) fitted[i] = level[group[i]];
            if (kind == 0) for (int i = 0; i < asked; i++) out[i] = level[askedGroup[i]];
            int wide = (n + 7) / 8;
            for (int g = 0; g < groups; g++) {
                int from = first[g], to = first[g + 1];
                if (kind == 1) begin(java.util.Arrays.copyOfRange(order, from, to));
                for (int t = 0; t < rounds; t++) {
                    int m = 0;
                    for (int i = from; i < to; i++) {
                        int row = order[i];
                        rest[row] = target[row] - fitted[row];
                        rows[m] = row;
                        m += used[t * wide + (row >> 3)] >> (7 - (row & 7)) & 1;
                    }
                    build(0, m, 0, 0);
                    for (int i = from; i < to; i++) fitted[order[i]] += leaf(codes, order[i] * width);
                    if (kind == 0) {
                        for (int i = firstAsked[g]; i < firstAsked[g + 1]; i++) out[orderAsked[i]] += leaf(askedCodes, orderAsked[i] * width);
                    } else if (cover[0] > 0) {
                        explain(0);
                    }
                }
                if (kind == 1)
                    for (int i = 0; i < shapley.length; i++) out[g * width + i % width] += Math.abs(shapley[i]);
            }
            return out;
        }

        void begin(int[] group) {
            int most = Math.min(depth, width);
            own = group;
            shapley = new double[group.length * width];
            low = new int[width];
            high = new int[width];
            share = new double[width];
            met = new boolean[width];
            names = new int[width];
            sizes = new double[most + 1];
            weight = new double[most + 1];
            table = new double[most << most];
            java.util.Arrays.fill(low, -1);
            java.util.Arrays.fill(high, Integer.MAX_VALUE);
            java.util.Arrays.fill(share, 1);
        }

        void explain(int node) {
            int f = feature[node];
            if (f < 0) {
                explainLeaf(node);
                return;
            }
            int wasLow = low[f], wasHigh = high[f], at = cut[node];
            double wasShare = share[f];
            boolean wasMet = met[f];
            met[f] = true;
            high[f] = Math.min(wasHigh, at);
            share[f] = wasShare * (cover[2 * node + 1] / cover[node]);
            explain(2 * node + 1);
            high[f] = wasHigh;
            low[f] = Math.max(wasLow, at);
            share[f] = wasShare * (cover[2 * node + 2] / cover[node]);
            explain(2 * node + 2);
            low[f] = wasLow;
            share[f] = wasShare;
            met[f] = wasMet;
        }

        /** A leaf is a game of the features on its way: a table of its Shapley values by which of them agree with a row. */
        void explainLeaf(int node) {
            double worth = value[node];
            int k = 0;
            for (int f = 0; f < width; f++) if (met[f]) names[k++] = f;
            if (k == 0 || worth == 0) return;
            weight[0] = 1.0 / k;  // s! (k - 1 - s)! / k!
            for (int s = 1; s < k; s++) weight[s] = weight[s - 1] * s / (k - s);
            for (int agree = 0; agree < 1 << k; agree++)
                for (int i = 0; i < k; i++) {
                    java.util.Arrays.fill(sizes, 0);
                    sizes[0] = 1;
                    for (int o = 0; o < k; o++) {
                        if (o == i) continue;
                        double outside = share[names[o]], agrees = agree >> o & 1;
                        for (int s = k - 1; s > 0; s--) sizes[s] = sizes[s] * outside + sizes[s - 1] * agrees;
                        sizes[0] *= outside;
                    }
                    double sum = 0;
                    for (int s = 0; s < k; s++) sum += sizes[s] * weight[s];
                    table[agree * k + i] = ((agree >> i & 1) - share[names[i]]) * sum * worth;
                }
            for (int r = 0; r < own.length; r++) {
                int first = own[r] * width, agree = 0;
                for (int i = 0; i < k; i++) {
                    int f = names[i], c = codes[first + f];
                    if (c > low[f] && c <= high[f]) agree |= 1 << i;
                }
                for (int i = 0; i < k; i++) shapley[r * width + names[i]] += table[agree * k + i];
            }
        }
    }
}
"""

_compiled: dict[str, object] = {}


def _function(spark: SparkSession):
    """The compiled function; its classes are told to the executors."""
    context = spark.sparkContext
    jvm, gateway = context._jvm, context._gateway
    compiler = jvm.org.codehaus.janino.SimpleCompiler()
    compiler.setParentClassLoader(jvm.Thread.currentThread().getContextClassLoader())
    compiler.cook(SOURCE)
    classes = compiler.getBytecodes()
    folder = tempfile.mkdtemp(prefix="panelkit-")
    register(shutil.rmtree, folder, True)
    jar = os.path.join(folder, "panelkit-trees.jar")
    with zipfile.ZipFile(jar, "w") as z:
        for name in classes.keySet():
            z.writestr(name.replace(".", "/") + ".class", bytes(classes.get(name)))
    context._jsc.addJar(f"file://{jar}")
    made = compiler.getClassLoader().loadClass("panelkit.Trees").getDeclaredConstructor(gateway.new_array(jvm.java.lang.Class, 0))
    return made.newInstance(gateway.new_array(jvm.java.lang.Object, 0))


def trees(spark: SparkSession) -> str | None:
    """Name of the session's function from a packed block to an array of numbers; None without a virtual machine."""
    if not hasattr(spark, "_jsparkSession"):
        return None
    application = spark.sparkContext.applicationId
    if application not in _compiled:
        _compiled.clear()
        _compiled[application] = _function(spark)
    kind = spark.sparkContext._jvm.org.apache.spark.sql.types.DataType.fromJson('{"type":"array","elementType":"double","containsNull":false}')
    spark._jsparkSession.udf().register(NAME, _compiled[application], kind)
    return NAME


def packed(kind: int, codes: np.ndarray, group: np.ndarray, target: np.ndarray, level: np.ndarray, used: np.ndarray, asked: np.ndarray,
           asked_group: np.ndarray, p) -> bytes:
    """A block for the function: bins, groups and targets of its rows, ``used`` with a bit for each round and row, and the rows asked for."""
    head = [kind, *codes.shape, p.bins, p.depth, p.min_rows, len(level), p.rounds, len(asked)]
    parts = ((head, "<i4"), ([p.rate], "<f8"), (target, "<f8"), (level, "<f8"), (group, "<i4"), (asked_group, "<i4"), (codes, "<i2"), (asked, "<i2"))
    return b"".join([*(np.asarray(a).astype(t).tobytes() for a, t in parts), used.tobytes()])
