"""SimHash near-duplicates by the general pigeonhole principle.

Fingerprints of 64 bits are cut into partitions of correlated bits. For each
fingerprint, dynamic programming deals tau + 1 units of threshold to the
partitions (a partition with none is not probed, one with k units is probed
within k - 1 bits) so that the estimated number of probes and candidates is
least. If two fingerprints differ by at most tau bits, then some partition
differs by at most the threshold that either of the two gives it, so every
link is found; candidates are verified on all 64 bits.

Fingerprints for which every allocation would read too many candidates (dense
groups of near copies) use an exact other way: two values within 2 bits share
a value within 1 bit of both, so they meet on their 65 neighbours. Groups on
such a value hold at most 65 fingerprints, whatever the corpus holds.

Defined results: null or empty texts have fingerprint zero and link like any
other; repeated rows are kept and share a class; null ids keep their row but
never name a class (the class of rows with null ids alone is null); an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabularium.llm import similar
from tabularium.llm.common import byte_values, components, discard, fresh, staged

BITS = 64
SHINGLE = 3
SEED = 42
#: Linked fingerprints differ by at most so many bits.
TAU = 2
#: Shingles hashed at once; bounds the memory that a long text takes.
CHUNK = 1 << 16
#: Costs in units of one candidate: sending a probe, and what sends a fingerprint to the other way.
PROBE_COST, MEET_COST = 2.0, 260.0


def fingerprint(data: bytes | None, size: int = SHINGLE) -> int:
    words = (data or b"").lower().split()
    if not words:
        return 0
    total, ones = max(1, len(words) - size + 1), np.zeros(BITS, np.int64)
    for low in range(0, total, CHUNK):
        high = min(total, low + CHUNK)
        part = words[low : high + size - 1]
        grams = [b" ".join(part)] if len(words) < size else map(b" ".join, zip(*(part[k:] for k in range(size)), strict=False))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, high - low)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total, bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): a row per document."""

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            fps = [fingerprint(x) for x in byte_values(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and in how many each pair of bits is set; over all of them."""

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, seen = np.zeros((BITS, BITS)), 0
        for batch in rows:
            values = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False))
            bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            for low in range(0, len(bits), CHUNK):
                both += bits[low : low + CHUNK].T @ bits[low : low + CHUNK]
            seen += len(values)
        flat = np.append(both.ravel(), seen).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["cell", "n"])

    sums = fps.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    flat = np.zeros(BITS * BITS + 1)
    for cell, n in sums.collect():  # 4097 rows, whatever the corpus holds
        flat[cell] = n
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def partitions_for(n: int) -> int:
    """How many partitions: those that read fewest candidates and probes if bits were even."""

    def cost(m: int) -> float:
        width, share = BITS / m, (TAU + 1) / m
        probes = m if share <= 1 else 1 + width + 1
        return probes * (PROBE_COST + n / 2.0**width)

    return min((2, 3, 4), key=cost)


def bit_groups(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m groups of about 64 / m bits; each grows by the bit that correlates most with what it holds."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    tie = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(tie, 0)
    left, groups = set(range(BITS)), []
    for k in range(m):
        size = len(left) // (m - k)
        order = sorted(left)
        seed = max(order, key=lambda b: (tie[b, order].max(), -b))
        group = [seed]
        left.remove(seed)
        while len(group) < size:
            best = max(sorted(left), key=lambda b: (tie[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def near_shares(p: np.ndarray, group: list[int]) -> list[float]:
    """The share of pairs within 0, 1, .. TAU bits in the group, if its bits were independent."""
    far = [1.0] + [0.0] * TAU
    for b in group:
        q = 2 * p[b] * (1 - p[b])
        far = [far[k] * (1 - q) + (far[k - 1] * q if k else 0.0) for k in range(TAU + 1)]
    return list(np.cumsum(far))


def allocate(costs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """costs[row, partition, units]: the units for each partition that sum to TAU + 1 at least cost, and that cost."""
    rows, m, choices = costs.shape
    best = np.full((rows, choices), np.inf)
    best[:, 0] = 0
    taken = []
    for i in range(m):
        options = np.full((rows, choices, choices), np.inf)  # by sum, units here
        for s in range(choices):
            for u in range(s + 1):
                options[:, s, u] = best[:, s - u] + costs[:, i, u]
        taken.append(options.argmin(axis=2))
        best = options.min(axis=2)
    left, units = np.full(rows, choices - 1), np.zeros((rows, m), np.int64)
    for i in reversed(range(m)):
        units[:, i] = taken[i][np.arange(rows), left]
        left -= units[:, i]
    return units, best[:, -1]


def _flips(group: list[int], reach: int) -> np.ndarray:
    """The masks of up to reach bits of the group."""
    ones = [1 << b for b in group]
    masks = [0]
    if reach >= 1:
        masks += ones
    if reach >= 2:
        masks += [a | b for k, a in enumerate(ones) for b in ones[:k]]
    return np.array(masks, np.uint64).view(np.int64)


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links among distinct fingerprints fp that join all that are within TAU bits; no pair of equals.

    Dense groups give a link from each member to the least member of the groups it meets in, which
    connects the same classes as all their pairs.
    """
    n, both = bit_statistics(fps)
    groups = bit_groups(n, both, partitions_for(n))
    shares = [near_shares(np.diag(both) / max(n, 1), g) for g in groups]
    masks = [int(np.array([sum(1 << b for b in g)], np.uint64).view(np.int64)[0]) for g in groups]
    meeting = len(groups)  # the number of the "partition" in which dense groups meet

    keys = F.array(*(F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(mask)).alias("key")) for i, mask in enumerate(masks)))
    index = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.part", "k.key")
    sizes = index.groupBy("part", "key").agg(F.count(F.lit(1)).alias("size"))
    counted = index.join(sizes, ["part", "key"]).groupBy("fp").agg(*(F.max(F.when(F.col("part") == i, F.col("size"))).alias(f"n{i}") for i in range(meeting)))

    widths = np.array([[0, 1, 1 + len(g), 1 + len(g) + len(g) * (len(g) - 1) // 2] for g in groups], float)
    spread = np.array([[0.0, 0.0] + [n * (s[k] - s[0]) for k in range(1, TAU + 1)] for s in shares])
    flips = [[_flips(g, k) for k in range(TAU + 1)] for g in groups]
    neighbours = _flips(list(range(BITS)), 1)

    def plan(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            sizes = np.stack([batch.column(1 + i).to_numpy(zero_copy_only=False) for i in range(meeting)], axis=1).astype(float)
            costs = PROBE_COST * widths[None] + spread[None] + sizes[:, :, None] * (np.arange(TAU + 2) > 0)
            units, least = allocate(costs)
            dense = least > MEET_COST
            out = [(np.repeat(fp[dense], len(neighbours)), meeting, (fp[dense][:, None] ^ neighbours).ravel())]
            for i in range(meeting):
                for u in range(1, TAU + 2):
                    own = fp[~dense & (units[:, i] == u)]
                    out.append((np.repeat(own, len(flips[i][u - 1])), i, ((own & masks[i])[:, None] ^ flips[i][u - 1]).ravel()))
            yield pa.RecordBatch.from_arrays([np.concatenate([x[0] for x in out]), np.concatenate([np.full(len(x[0]), x[1], np.int32) for x in out]), np.concatenate([x[2] for x in out])], ["a", "part", "key"])

    probes = staged(counted.mapInArrow(plan, "a long, part int, key long"), "probes")
    near = (F.col("a") != F.col("fp")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= TAU)
    found = probes.where(F.col("part") < meeting).alias("p").join(index.alias("x"), (F.col("p.part") == F.col("x.part")) & (F.col("p.key") == F.col("x.key")) & near).select("a", F.col("fp").alias("b"))
    met = probes.where(F.col("part") == meeting).groupBy("key").agg(F.collect_set("a").alias("all")).where(F.size("all") > 1)
    met = met.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a <> b")
    both_ways = found.unionByName(met).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    out = staged(both_ways, "links")
    discard(probes)
    return out


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): a row per document; see the module's text."""
    rows = staged(fingerprints(docs, doc_id, text), "fingerprints")
    groups = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "groups")
    named = _named(groups, links(groups.select("fp")))
    return rows.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _named(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """(fp, component_id): the least first of groups (fp, first) in each class that edges (a, b) join."""
    if edges.isEmpty():
        return groups.select("fp", F.col("first").alias("component_id"))
    rooted = groups.join(components(edges), F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    # one row per fingerprint at most, so a class of n distinct fingerprints is n rows
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(least, "root").select("fp", "component_id")


def similar_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, component_id) as near_duplicates() has them, with the links of similar.pairs() besides those of fingerprints."""
    columns = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    hashed = columns.select("doc_id", F.xxhash64("text").alias("t"), "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(x) for x in byte_values(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], ["doc_id", "t", "fp"])

    rows = staged(hashed.mapInArrow(run, "doc_id long, t long, fp long"), "fingerprints")
    groups = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "groups")
    of = rows.groupBy("t").agg(F.first("fp").alias("fp"))
    sides = [of.select(F.col("t").alias(x), F.col("fp").alias(f"fp_{x}")) for x in "ab"]
    copies = similar.pairs(columns).join(sides[0], "a").join(sides[1], "b").select(F.greatest("fp_a", "fp_b").alias("a"), F.least("fp_a", "fp_b").alias("b")).where("a <> b")
    edges = staged(links(groups.select("fp")).unionByName(copies).distinct(), "edges")
    return rows.join(_named(groups, edges), "fp").select("doc_id", "component_id")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each class of similar_classes(), that with the smallest id, all columns as they are.

    Rows with a null id stay, for no id can stand for them; repeated rows of one id and text are cut to one.
    """
    classes = similar_classes(docs, doc_id, text)
    kept = fresh(docs, "kept_id")
    keepers = classes.where("doc_id = component_id").select(F.col("doc_id").alias(kept)).distinct()
    named = docs.join(keepers, F.col(doc_id).cast("long") == F.col(kept), "left_semi").dropDuplicates([doc_id, text])
    return named.unionByName(docs.where(F.col(doc_id).isNull()))
