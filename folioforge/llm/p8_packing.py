"""Problem 8: documents in containers of fixed capacity.

Method. Only lengths matter, so the histogram of lengths - no more entries than the capacity, however many documents - goes
to the driver. There shallow combinations of lengths that fill a container up to a small window are enumerated,
non-negative least squares gives how often to repeat each so that together they use up the histogram, the numbers are rounded
down to what is available, and what remains is packed greedily, largest length first, each pattern repeated as often as its
lengths last. The plan maps (length, rank among the documents of that length) to a container. Ranks are given in
salted parts of each length, so a length that a third of all documents share doesn't meet in one task.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.vocab import TOKENIZERS, Counter, read_ranks
from folioforge.session import written

ROWS_A_SALT, MOST_SALTS = 500_000, 1024


def sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, tokens) of every row; null and empty texts have 0."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def run(batches):
        count = Counter(ranks.value).count
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([count(x) for x in b.column(1).to_pylist()], pa.int64())], names=["doc_id", "tokens"])

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string")).mapInArrow(run, "doc_id bigint, tokens bigint")


def combinations(hist: np.ndarray, capacity: int, window: int, per_length: int = 12) -> list[dict[int, int]]:
    """Combinations of at most three different lengths, some of them repeated, that fill a container but for `window` units."""
    have = np.flatnonzero(hist).tolist()
    known = set(have)
    out: dict[tuple, dict[int, int]] = {}
    for a in reversed(have):
        made = 0
        for m in range(capacity // a, 0, -1):
            rest = capacity - m * a
            if rest <= window:
                out[((a, m),)] = {a: m}
                made += 1
                continue
            # the second length so that the third, if one is needed, fills exactly
            for b in (x for x in (rest, rest // 2, rest // 3, rest * 2 // 3, rest * 3 // 4, rest // 4) if x):
                k = bisect_right(have, b) - 1
                if k < 0:
                    continue
                for b2 in have[max(0, k - 1) : k + 1]:
                    n = rest // b2
                    for t in {1, n}:
                        left = rest - t * b2
                        if left <= window:
                            c = {a: m}
                            c[b2] = c.get(b2, 0) + t
                        elif left in known:
                            c = {a: m}
                            c[b2] = c.get(b2, 0) + t
                            c[left] = c.get(left, 0) + 1
                        else:
                            continue
                        out.setdefault(tuple(sorted(c.items())), c)
                        made += 1
            if made >= per_length:
                break
    return list(out.values())


def nnls(columns: list[dict[int, int]], hist: np.ndarray, sweeps: int = 30) -> np.ndarray:
    """x >= 0 that makes the sum of x times the columns closest to the histogram in squares, by coordinate descent."""
    at = [np.fromiter(c.keys(), np.int64, len(c)) for c in columns]
    by = [np.fromiter(c.values(), np.float64, len(c)) for c in columns]
    norm = [float(v @ v) for v in by]
    left, x = hist.astype(np.float64), np.zeros(len(columns))
    for _ in range(sweeps):
        moved = 0.0
        for i in range(len(columns)):
            step = max(-x[i], float(left[at[i]] @ by[i]) / norm[i])
            if step:
                x[i] += step
                left[at[i]] -= step * by[i]
                moved += abs(step)
        if moved < 1e-3 * max(1.0, x.sum()):
            break
    return x


def plan(hist: np.ndarray, capacity: int, windows: tuple[int, ...] = (0, 2, 16)) -> list[tuple[dict[int, int], int]]:
    """Patterns (length to multiplicity) and how often each is used; together they use every length exactly as often as `hist` says.

    The best of the plans for each window; where few lengths combine well, taking nothing before the greedy part is one of them.
    """
    plans = [filled(hist, capacity, w) for w in windows] + [filled(hist, capacity, None)]
    return min(plans, key=lambda p: sum(n for _, n in p))


def filled(hist: np.ndarray, capacity: int, window: int | None) -> list[tuple[dict[int, int], int]]:
    """A plan whose combinations leave at most `window` units free, and the greedy rest; the greedy part alone without a window."""
    left, out = hist.astype(np.int64).copy(), []
    columns = combinations(left, capacity, window) if window is not None else []
    x = nnls(columns, left)
    for i in np.argsort(-x, kind="stable").tolist():
        n = min(int(x[i] + 1e-6), *(int(left[k]) // m for k, m in columns[i].items()))
        if n > 0:
            out.append((columns[i], n))
            for k, m in columns[i].items():
                left[k] -= n * m
    have = np.flatnonzero(left).tolist()
    while have:
        rest, pattern = capacity, {}
        k = len(have)
        while k:
            k = bisect_right(have, rest, 0, k)
            if not k:
                break
            size = have[k - 1]
            m = min(rest // size, int(left[size]))
            pattern[size] = m
            rest -= m * size
            k -= 1
        n = min(int(left[s]) // m for s, m in pattern.items())
        out.append((pattern, n))
        for s, m in pattern.items():
            left[s] -= n * m
        have = [s for s in have if left[s]]
    return out


def slots(patterns: list[tuple[dict[int, int], int]], shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (length << shift | first rank), with the first container and the multiplicity from there on."""
    used: dict[int, int] = {}
    rows, container = [], 0
    for pattern, n in patterns:
        for size, m in pattern.items():
            rows.append((size << shift | used.get(size, 0), container, m))
            used[size] = used.get(size, 0) + n * m
        container += n
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 3)
    return a[:, 0].copy(), a[:, 1].copy(), a[:, 2].copy()


def pack(lengths: DataFrame, capacity: int = 2048, salts: int | None = None) -> DataFrame:
    """(doc_id, part, tokens, container): where each document goes, given (doc_id, tokens).

    A document longer than the capacity is split into full parts and the rest, parts 0, 1, ...; any other is part 0. Rows
    with no tokens (null and empty texts) aren't placed. Repeated rows are documents of their own. Containers are numbered from 0. An
    empty table gives none. A length's documents are ranked in `salts` parts, by default one for each ROWS_A_SALT documents in all, MOST_SALTS at the most.
    """
    parts = lengths.where("tokens > 0").select(
        "doc_id",
        F.posexplode(F.expr(f"transform(sequence(0, cast((tokens - 1) div {capacity} as int)), i -> least({capacity}L, tokens - i * {capacity}L))")).alias("part", "tokens"),
    )
    parts = written(parts, "parts")
    salts = salts or max(1, min(MOST_SALTS, parts.count() // ROWS_A_SALT))
    parts = parts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "part"), F.lit(salts)).cast("int"))
    counted = parts.groupBy("tokens", "salt").count().collect()  # at most capacity x salts rows
    hist = np.zeros(capacity + 1, np.int64)
    first = np.zeros((capacity + 1, salts), np.int64)
    for r in sorted(counted, key=lambda r: (r.tokens, r.salt)):
        first[r.tokens, r.salt] = int(hist[r.tokens])
        hist[r.tokens] += r["count"]
    shift = 48
    sent = parts.sparkSession.sparkContext.broadcast((first, slots(plan(hist, capacity), shift)))  # bounded by the capacity
    local = F.expr("row_number() over (partition by tokens, salt order by doc_id, part) - 1").cast("long")

    def run(batches):
        first, (keys, base, mult) = sent.value
        for b in batches:
            tokens, salt, rank = (b.column(i).to_numpy() for i in (2, 3, 4))
            rank = rank + first[tokens, salt]
            at = np.searchsorted(keys, tokens << shift | rank, "right") - 1
            container = base[at] + (rank - (keys[at] & (1 << shift) - 1)) // mult[at]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(container)], names=["doc_id", "part", "tokens", "container"])

    return parts.select("doc_id", "part", "tokens", "salt", local.alias("rank")).mapInArrow(run, "doc_id bigint, part int, tokens bigint, container bigint")


def p8_containers(spark, sf_dir: str) -> DataFrame:
    """Every non-empty document's container of 2,048 tokens of byte_bpe_50k."""
    return pack(sizes(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def p8_fill(spark, sf_dir: str) -> DataFrame:
    """Containers used, the least number that could hold all tokens, and the share of room that is filled."""
    c = p8_containers(spark, sf_dir).groupBy("container").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("parts"))
    return c.agg(F.count(F.lit(1)).alias("containers"), F.ceil(F.sum("tokens") / 2048).alias("least"), (F.sum("tokens") / (F.count(F.lit(1)) * 2048)).alias("filled"))
