"""Best-fit packing by a linear grouping scheme.

Texts are measured in BPE tokens and cut into pieces of at most CAPACITY tokens; a piece that fills a bin has it alone.
Of the rest, pieces over CAPACITY / SMALL tokens are large. In falling order they are dealt into GROUPS groups of equal
cardinality and rounded up to the longest of their group, which leaves few sizes. How often each combination of sizes
that fits a bin is used is optimised as a linear program (columns are generated by a knapsack), rounded down, and
completed by the fullest combinations of what is left. Then the actual pieces take the places of their group's size,
and the small ones go, longest first, where they leave the least room (best fit), opening bins only where none fits.

All of this needs only how many pieces have each length, at most CAPACITY numbers whatever the input, and gives runs:
so many pieces of a length, by rank, into consecutive bins. Pieces are sorted by length, doc_id and piece over all
tasks; a task knows how many pieces of each of its lengths come before it, so pieces get their ranks, and look up their
runs, without a group for a length, and no step is sequential in the number of documents.

Defined cases: a null or empty text has one row with n_tokens 0 and no bin; a null id stays null and takes part.
Ties in length are broken by doc_id and piece; repeated rows are packed each. Extra columns are left alone.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import BPE_BYTES, PATTERN, VOCABULARY, Encoder, ranks
from .text import documents, integer_id, pieces, quoted, ready

CAPACITY = 2048
GROUPS = 16
SMALL = 8


def best_combination(sizes: list[int], values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes within the capacity of the most value."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    s = np.array(sizes)
    for room in range(min(sizes), capacity + 1):
        fits = s <= room
        gain = np.where(fits, values + best[np.maximum(room - s, 0)], -1.0)
        k = int(gain.argmax())
        best[room], took[room] = (gain[k], k) if gain[k] > best[room - 1] else (best[room - 1], -1)
    count, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if took[room] < 0:
            room -= 1
        else:
            count[took[room]] += 1
            room -= sizes[took[room]]
    return float(best[capacity]), count


def combinations(sizes: list[int], wanted: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(places by size, number of bins) that hold exactly the wanted numbers, in nearly the fewest bins."""
    if not sizes:
        return []
    m = len(sizes)
    basis = [np.eye(m, dtype=np.int64)[k] * (capacity // sizes[k]) for k in range(m)]
    for _ in range(400):
        a = np.array(basis, float).T
        x = np.linalg.solve(a, wanted.astype(float))
        price = np.linalg.solve(a.T, np.ones(m))
        value, column = best_combination(sizes, np.maximum(price, 0), capacity)
        if value <= 1 + 1e-7:
            break
        d = np.linalg.solve(a, column.astype(float))
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        basis[int(ratio.argmin())] = column
    left, out = wanted.astype(np.int64).copy(), []
    for places, n in zip(basis, np.floor(x + 1e-7).astype(np.int64)):
        n = int(min([n, *(left[places > 0] // places[places > 0])]))
        if n > 0:
            out.append((places, n))
            left = left - places * n
    while left.any():
        room, places = capacity, np.zeros(m, np.int64)
        for k in np.argsort(-np.array(sizes), kind="stable"):
            places[k] = min(left[k], room // sizes[k])
            room -= places[k] * sizes[k]
        n = int((left[places > 0] // places[places > 0]).min())
        out.append((places, n))
        left = left - places * n
    return out


def plan(lengths: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, pieces, first bin, pieces a bin, position in the bin), and the number of bins."""
    runs: list[tuple[int, int, int, int, int, int]] = []
    used = {n: 0 for n in lengths}
    bins = 0
    if lengths.get(capacity):
        runs.append((capacity, 0, lengths[capacity], 0, 1, 0))
        bins = lengths[capacity]
    large = sorted((n for n in lengths if capacity / small < n < capacity), reverse=True)
    each = -(-sum(lengths[n] for n in large) // groups)
    group: list[list[list[int]]] = []  # runs of [length, pieces] of each group
    sizes: list[int] = []
    room = 0
    for n in large:
        c = lengths[n]
        while c:
            if not room:
                group.append([])
                sizes.append(n)
                room = each
            k = min(c, room)
            group[-1].append([n, k])
            c, room = c - k, room - k
    wanted = np.array([sum(k for _, k in g) for g in group], np.int64)
    merged = sorted(set(sizes), reverse=True)  # groups may have one size
    queue = {s: [r for g, t in zip(group, sizes) if t == s for r in g] for s in merged}
    free: list[tuple[int, int, int]] = []  # (room, first bin, bins), ascending
    for places, count in combinations(merged, np.array([sum(w for w, t in zip(wanted, sizes) if t == s) for s in merged], np.int64), capacity):
        parts = [(0, count, 0)]  # (first of these bins, bins, tokens in them)
        for s, k in zip(merged, places):
            for _ in range(int(k)):
                new = []
                for first, n, fill in parts:
                    while n:
                        run = queue[s][0]
                        m = min(n, run[1])
                        runs.append((run[0], used[run[0]], m, bins + first, 1, fill))
                        used[run[0]] += m
                        new.append((first, m, fill + run[0]))
                        first, n = first + m, n - m
                        run[1] -= m
                        if not run[1]:
                            queue[s].pop(0)
                parts = new
        for first, n, fill in parts:
            if fill < capacity:
                insort(free, (capacity - fill, bins + first, n))
        bins += count
    for n in sorted((n for n in lengths if 0 < n <= capacity / small), reverse=True):
        c = lengths[n]
        while c:
            at = bisect_left(free, (n, -1, -1))
            if at == len(free):
                need = -(-c // (capacity // n))
                free.append((capacity, bins, need))
                bins += need
            room, first, count = free.pop(at)
            q = room // n
            m = min(count, c // q)
            if not m:
                q, m = c, 1
            runs.append((n, used[n], q * m, first, q, capacity - room))
            used[n] += q * m
            c -= q * m
            if room > q * n:
                insort(free, (room - q * n, first, m))
            if count > m:
                insort(free, (room, first + m, count - m))
    return np.array(sorted(runs), np.int64).reshape(-1, 6), bins


def lengths_of(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    words = docs.sparkSession.sparkContext.broadcast(ranks(vocabulary))

    def measure(batches):
        coder = Encoder(words.value, pattern)
        for batch in batches:
            for piece in pieces(batch, "text", BPE_BYTES):
                yield pa.record_batch({"doc_id": piece["doc_id"], "total": pa.array(coder.counts(piece["text"]))})

    return docs.mapInArrow(measure, "doc_id long, total long")


def packed(docs: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN, length_col: str | None = None) -> DataFrame:
    """doc_id, piece, start_token, n_tokens, bin and position (of its first token in the bin). length_col, if given, has the tokens of each text."""
    spark = ready(docs.sparkSession)
    if length_col is None:
        totals = lengths_of(documents(docs, id_col, text_col), vocabulary, pattern)
    else:
        totals = docs.select(integer_id(docs, id_col).alias("doc_id"), F.coalesce(quoted(length_col), F.lit(0)).cast("long").alias("total"))
    cut = totals.select("doc_id", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.expr(f"(total - 1) div {capacity}")))).alias("piece"))
    cut = cut.select("doc_id", F.col("piece").cast("int").alias("piece"), (F.col("piece") * capacity).alias("start_token"), F.least(F.lit(capacity).cast("long"), F.col("total") - F.col("piece") * capacity).cast("int").alias("n_tokens")).checkpoint()
    # by ranges of (length, doc_id, piece): a length that a third of all pieces have is spread over many tasks
    order = ["n_tokens", "doc_id", "piece"]
    ranged = cut.where("n_tokens > 0").repartitionByRange(*order).sortWithinPartitions(*order).checkpoint()
    held = ranged.groupBy(F.spark_partition_id().alias("part"), "n_tokens").count().collect()  # a row for each task and each length
    counted: dict[int, int] = {}
    first: dict[tuple[int, int], int] = {}
    for part, n, count in sorted(tuple(r) for r in held):
        first[part, n] = counted.get(n, 0)
        counted[n] = first[part, n] + count
    runs, _ = plan(counted, capacity, groups, small)
    shared = spark.sparkContext.broadcast((runs, first))

    def place(batches):
        r, first = shared.value
        part, seen = TaskContext.get().partitionId(), Counter()
        key = r[:, 0] << 44 | r[:, 1]
        for batch in batches:
            n = batch["n_tokens"].to_numpy().astype(np.int64)
            names, begin, size = np.unique(n, return_index=True, return_counts=True)
            base = np.array([first[part, k] + seen[k] for k in names.tolist()], np.int64) - begin
            seen.update(dict(zip(names.tolist(), size.tolist())))
            rank = np.arange(len(n)) + np.repeat(base, size)
            at = np.searchsorted(key, n << 44 | rank, "right") - 1
            k, q = rank - r[at, 1], r[at, 4]
            cols = [batch[c] for c in ("doc_id", "piece", "start_token", "n_tokens")]
            yield pa.record_batch([*cols, pa.array(r[at, 3] + k // q), pa.array((r[at, 5] + k % q * n).astype(np.int32))], names=["doc_id", "piece", "start_token", "n_tokens", "bin", "position"])

    schema = "doc_id long, piece int, start_token long, n_tokens int, bin long, position int"
    none = cut.where("n_tokens = 0").select("doc_id", "piece", "start_token", "n_tokens", F.lit(None).cast("long").alias("bin"), F.lit(None).cast("int").alias("position"))
    return ranged.mapInArrow(place, schema).union(none)
