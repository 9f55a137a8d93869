"""SimHash near-dedup by the generalised pigeonhole principle.

A fingerprint has 64 bits. Bits that go together are put into the same part; ``m`` parts get thresholds ``t_1..t_m`` with
``sum(t_i) = distance - m + 1``. Any two fingerprints within ``distance`` bits then differ in at most ``t_i`` bits of some
part ``i``: otherwise they would differ in at least ``sum(t_i + 1) = distance + 1``. A part with threshold -1 is not used.
Number of parts and thresholds come from dynamic programming over the estimated cost: rows to write and candidates to
verify, from counts over all fingerprints. Probes enumerate the values within ``t_i`` bits of a part; candidates meet
on (part, value) and are verified on the whole fingerprint inside the join.

Defined cases: a text without words (or null) has fingerprint zero and is linked like any other; shorter texts than a
shingle give the whole sequence as the only shingle; equal fingerprints are linked at distance zero without pairing
them up; rows with equal ids are separate rows with the same id; null ids are kept and never become a component's
id unless all its ids are null; an empty table gives no rows. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import xxhash
from pyspark.sql import Column, DataFrame

from tidewright.llm.common import map_arrow, materialize
from tidewright.llm.components import components, local_forest

SEED = 42
#: Estimated cost of a row that is written and sorted, against that of a candidate that is verified.
ROW_COST, PAIR_COST = 1.0, 0.02
#: Fingerprints of a value that all others there meet, before pairs are made.
PIVOTS = 3
#: Shingles whose bits are counted at a time, so a very long text needs no more memory than that.
BLOCK = 1 << 12


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 of each shingle of ``width`` words (all words, where there are fewer), joined by spaces."""
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], dtype=np.uint64)
    joined = b" ".join(words)
    starts = [0]
    for w in words:
        starts.append(starts[-1] + len(w) + 1)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[width:])], dtype=np.uint64)


def bit_counts(rows: np.ndarray) -> np.ndarray:
    """How many rows (of bytes) have each bit. Eight one-byte counts are added at once, so up to 255 rows at a time."""
    counts = np.zeros(8 * rows.shape[1], dtype=np.int64)
    for at in range(0, len(rows), BLOCK):
        lanes = np.unpackbits(rows[at : at + BLOCK], axis=1).view(np.uint64)
        sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)
        counts += np.ascontiguousarray(sums).view(np.uint8).sum(axis=0, dtype=np.int64)
    return counts


def majority(hashes: np.ndarray) -> int:
    """The 64-bit fingerprint: each bit that is set in over half of the hashes."""
    if not len(hashes):
        return 0
    counts = bit_counts(hashes.astype(">u8").view(np.uint8).reshape(-1, 8))
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = []
        for text in batch.column(1):
            words = (text.as_py() or "").encode().lower().split()
            prints.append(_signed(majority(shingle_hashes(words, width))))
        yield pa.record_batch([batch.column(0), pa.array(prints, pa.int64())], names=["id", "fp"])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """``id, fp``: the signed 64-bit SimHash of every whole text."""
    chosen = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    return map_arrow(chosen, partial(_fingerprint_batches, width=width), "id bigint, fp bigint")


# --- Parts and thresholds -------------------------------------------------------------------------------------------


def _bit_matrix(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.astype(np.int64).view(np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def _count_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, rows = np.zeros((64, 64)), 0
    for batch in batches:
        bits = _bit_matrix(batch.column(0).to_numpy()).astype(np.float64)
        total += bits.T @ bits
        rows += len(bits)
    i, j = np.indices((64, 64)).reshape(2, -1)
    out = [pa.array(np.append(x, y).astype(np.int64)) for x, y in ((i, -1), (j, -1), (total.ravel(), rows))]
    yield pa.record_batch(out, names=["i", "j", "n"])


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and, for each two bits, how many have both: 64 x 64 counts over all rows."""
    counted = map_arrow(prints.select("fp"), _count_bits, "i bigint, j bigint, n bigint").groupBy("i", "j").agg(F.sum("n").alias("n"))
    both, rows = np.zeros((64, 64)), 0
    for r in counted.collect():
        if r["i"] < 0:
            rows = r["n"]
        else:
            both[r["i"], r["j"]] = r["n"]
    return rows, both


def group_bits(rows: int, both: np.ndarray, m: int) -> list[list[int]]:
    """``m`` parts of nearly equal width; correlated bits share a part, so that the parts differ independently."""
    p = both.diagonal() / max(rows, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    related = np.abs(both / max(rows, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(related, 0)
    left, parts = list(range(64)), []
    for k in range(m):
        width = len(left) // (m - k)
        part = [max(left, key=lambda b: (related[b, left].max(), -b))]
        while len(part) < width:
            rest = [b for b in left if b not in part]
            part.append(max(rest, key=lambda b: (related[b, part].sum(), -b)))
        parts.append(sorted(part))
        left = [b for b in left if b not in part]
    return parts


def allocate(rows: int, both: np.ndarray, parts: list[list[int]], distance: int) -> tuple[float, list[int]]:
    """Cheapest thresholds for the parts, and the cost, by dynamic programming over the sum that is still to give."""
    p = both.diagonal() / max(rows, 1)
    differ = 2 * p * (1 - p)
    # Estimated cost of each part at each threshold: its rows, and pairs within the threshold.
    costs = []
    for part in parts:
        spread = np.array([1.0])  # how many bits of the part two fingerprints differ in
        for b in part:
            spread = np.convolve(spread, [1 - differ[b], differ[b]])
        cost, balls, within = {-1: 0.0}, 0, 0.0
        for t in range(min(distance, len(part), 3) + 1):
            balls += comb(len(part), t)
            within += spread[t]
            cost[t] = ROW_COST * rows * (1 + balls) + PAIR_COST * rows * rows / 2 * within
        costs.append(cost)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for given, (paid, chosen) in best.items():
            for t, c in cost.items():
                now = (paid + c, [*chosen, t])
                if given + t not in step or now < step[given + t]:
                    step[given + t] = now
        best = step
    return best.get(distance - len(parts) + 1, (float("inf"), []))


def plan_parts(rows: int, both: np.ndarray, distance: int) -> list[tuple[list[int], int]]:
    """Parts with their thresholds, for the number of parts that costs least."""
    options = []
    for m in range(1, distance + 2):
        parts = group_bits(rows, both, m)
        cost, chosen = allocate(rows, both, parts, distance)
        if chosen:
            options.append((cost, m, [(part, t) for part, t in zip(parts, chosen, strict=True) if t >= 0]))
    return min(options)[2]


# --- Candidates and links --------------------------------------------------------------------------------------------


def _mask(bits: list[int] | tuple[int, ...]) -> int:
    return sum(1 << (63 - b) for b in bits)


def _entries(number: int, value: Column, masks: Column) -> Column:
    return F.transform(masks, lambda x: F.struct(F.lit(number).alias("part"), value.bitwiseXOR(x).alias("value")))


def _keyed(prints: DataFrame, plan: list[tuple[list[int], int]], probes: bool) -> DataFrame:
    """A row for each part (and, for probes, each value within the threshold): ``part, value`` and the columns there."""
    keys = []
    for number, (part, threshold) in enumerate(plan):
        flips = [c for t in range((threshold if probes else 0) + 1) for c in combinations(part, t)]
        value = F.col("fp").bitwiseAND(F.lit(_signed(_mask(part))))
        masks = F.array(*[F.lit(_signed(_mask(c))) for c in flips])
        keys.append(_entries(number, value, masks))
    return prints.select("*", F.explode(F.concat(*keys)).alias("k")).select("k.part", "k.value", *prints.columns)


def _sides(prints: DataFrame, plan: list[tuple[list[int], int]]) -> list[DataFrame]:
    """``part, value, i_*`` and ``part, value, p_*``: what is looked up, and what looks; ``prints`` has ``fp`` and more columns."""
    return [_keyed(prints, plan, s == "p").withColumnsRenamed({c: f"{s}_{c}" for c in prints.columns}) for s in "ip"]


def _met(index: DataFrame, probe: DataFrame, distance: int, unlike: str) -> DataFrame:
    """What meets on (part, value) within ``distance`` bits and differs in ``unlike``."""
    close = F.bit_count(F.col("i_fp").bitwiseXOR(F.col("p_fp"))) <= distance
    return index.hint("merge").join(probe, ["part", "value"]).where(close & F.expr(unlike))


def _met_apart(rooted: DataFrame, plan: list[tuple[list[int], int]], distance: int) -> DataFrame:
    """Links (``a``, ``b``) between fingerprints of different roots (``fp, root``) that lie within ``distance`` bits: all of them.

    At a value of a part nearly all rows are of one root, its head, and rows of one root must not meet each other. So what is not of the
    head meets all that probes the value, and what is of the head meets only probes of other roots.
    """
    index, probe = _sides(rooted, plan)
    sizes = index.groupBy("part", "value", "i_root").agg(F.count("*").alias("n"))
    heads = sizes.groupBy("part", "value").agg(F.max(F.struct("n", "i_root"))["i_root"].alias("head"), F.count("*").alias("n_roots"))
    seen = probe.join(heads, ["part", "value"]).where((F.col("n_roots") > 1) | (F.col("p_root") != F.col("head")))
    placed = index.join(heads, ["part", "value"])
    parts = []
    for side, probes in ((F.col("i_root") != F.col("head"), seen.where("n_roots > 1")), (F.col("i_root") == F.col("head"), seen.where("p_root <> head"))):
        met = _met(placed.where(side).select(*index.columns), probes.select(*probe.columns), distance, "i_root <> p_root")
        parts.append(met.select(F.col("i_fp").alias("a"), F.col("p_fp").alias("b")))
    return parts[0].union(parts[1])


def print_roots(distinct: DataFrame, distance: int) -> DataFrame:
    """``fp, root``: the smallest fingerprint that each distinct fingerprint reaches by links of up to ``distance`` bits.

    In a large group nearly all fingerprints are within reach of each other, so pairs aren't made at once. First each
    fingerprint meets a few of each value that it probes, the least by some salts: as many rows as ``PIVOTS`` times the probes at
    most. After that only fingerprints meet whose roots still differ, so no link between groups is left out.
    """
    distinct = distinct.select("fp")
    plan = plan_parts(*bit_statistics(distinct), distance)
    index, probe = _sides(distinct, plan)
    salts = [F.lit(_signed(k * 0x9E3779B97F4A7C15 % (1 << 64))) for k in range(PIVOTS)]
    least = index.groupBy("part", "value").agg(*[F.min(F.col("i_fp").bitwiseXOR(x)).bitwiseXOR(x).alias(f"c{k}") for k, x in enumerate(salts)])
    chosen = least.select("part", "value", F.explode(F.array_distinct(F.array(*[f"c{k}" for k in range(PIVOTS)]))).alias("i_fp"))
    found = _met(chosen, probe, distance, "i_fp <> p_fp").select(F.col("i_fp").alias("a"), F.col("p_fp").alias("b"))
    links = materialize(map_arrow(found, local_forest, "a bigint, b bigint"), "print-links")
    for last in (False, True):
        joined = distinct.join(components(links).withColumnRenamed("node", "fp"), "fp", "left")
        roots = materialize(joined.select("fp", F.coalesce("root", "fp").alias("root")), "print-roots")
        if not last:
            found = _met_apart(roots, plan, distance)
            links = links.union(materialize(map_arrow(found, local_forest, "a bigint, b bigint"), "print-links"))
    return roots


def find_near(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, distance: int = 4) -> DataFrame:
    """One row for each document: ``key, fingerprint`` (16 hex digits), ``component_id``: the smallest id reachable."""
    prints = materialize(fingerprints(docs, key, text, width), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("id").alias("least_id")), "distinct")
    rooted = distinct.join(print_roots(distinct, distance), "fp")
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(
        F.col("id").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


# --- Near copies by similarity ---------------------------------------------------------------------------------------
# The pigeonhole's groups come first: each text is compared with one of its group, so that large groups are one before pairs are
# made. Fingerprints don't decide; texts do. An equi-join on prefixes then finds all that is left: put the shingles of all texts in
# one order. Two sets of similarity s then share one of the first n - ceil(s * n) + 1 shingles of each. Any order loses nothing;
# with rare shingles first, few texts meet that aren't similar.

#: Words of the parity bits of a set: two sets differ in at least as many shingles as these do in bits.
PARITY = 4
#: One in so many texts is asked which shingles are common, and so many shingles at most are ranked. Both only change the order.
SAMPLE, RANKED = 16, 200_000
#: Keys that two components share (16 bytes each), and ids that go, are broadcast up to this many; beyond, the join shuffles.
BROADCAST_KEYS = 2_000_000
PARITY_COLUMNS = [f"p{k}" for k in range(PARITY)]


def shingle_set(text: str | None, width: int) -> np.ndarray:
    return np.unique(shingle_hashes((text or "").encode().lower().split(), width))


def parity_bits(hashes: np.ndarray) -> np.ndarray:
    """``PARITY`` signed words: each bit tells whether an odd number of the hashes falls on it."""
    counts = np.bincount((hashes >> np.uint64(32)).astype(np.int64) % (64 * PARITY), minlength=64 * PARITY)
    return np.packbits(counts % 2 == 1).view(np.int64)


def prefix_of(hashes: np.ndarray, similarity: float, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first hashes of a sorted set, rare ones first, of which any set of that similarity shares one."""
    rank = np.zeros(len(hashes), dtype=np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        rank = np.where(common[at] == hashes, counts[at], 0)
    length = len(hashes) - int(np.ceil(similarity * len(hashes) - 1e-6)) + 1
    return hashes[np.argsort(rank, kind="stable")[:length]]


def _shingle_batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in batch.column(0):
            yield pa.record_batch([pa.array(shingle_set(text.as_py(), width).view(np.int64))], names=["key"])


def common_shingles(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The commonest shingles of a sample of ``docs`` (``id, text``), sorted, and their counts."""
    sample = docs.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0).select("text")
    found = map_arrow(sample, partial(_shingle_batches, width=width), "key bigint").groupBy("key").agg(F.count("*").alias("n"))
    table = found.where("n > 1").orderBy(F.desc("n"), "key").limit(RANKED).toArrow()
    keys, counts = table["key"].to_numpy().view(np.uint64), table["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order], counts[order]


def _set_batches(
    batches: Iterator[pa.RecordBatch], width: int, similarity: float, common: np.ndarray, counts: np.ndarray
) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, prints, sizes, parities, prefixes = [], [], [], [], []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if len(hashes := shingle_set(text.as_py(), width)):
                ids.append(i)
                prints.append(_signed(majority(hashes)))
                sizes.append(len(hashes))
                parities.append(parity_bits(hashes))
                prefixes.append(prefix_of(hashes, similarity, common, counts).view(np.int64))
        parity = np.array(parities, dtype=np.int64).reshape(-1, PARITY).T
        columns = [pa.array(ids, pa.int64()), pa.array(prints, pa.int64()), pa.array(sizes, pa.int32()), *map(pa.array, parity)]
        columns.append(pa.array(prefixes, pa.list_(pa.int64())))
        yield pa.record_batch(columns, names=["id", "fp", "size", *PARITY_COLUMNS, "prefix"])


def _similar_batches(batches: Iterator[pa.RecordBatch], width: int, similarity: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("text_a"), batch.column("text_b"), strict=True):
            one, other = shingle_set(x.as_py(), width), shingle_set(y.as_py(), width)
            shared = len(np.intersect1d(one, other, assume_unique=True))
            keep.append(shared >= similarity * (len(one) + len(other) - shared))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _similar_links(batches: Iterator[pa.RecordBatch], width: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """The similar pairs of a task, as a forest: one Python worker does both."""
    return local_forest(_similar_batches(batches, width, similarity))


def _compared(pairs: DataFrame, docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs of at least that similarity, by their texts. Only texts of some pair move."""
    pairs = materialize(pairs.distinct(), "near-pairs")
    ids = materialize(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "near-ids")
    texts = docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_KEYS else ids, "id", "left_semi")
    for s in "ab":
        pairs = pairs.join(texts.select(F.col("id").alias(s), F.col("text").alias(f"text_{s}")), s)
    found = map_arrow(pairs, partial(_similar_links, width=width, similarity=similarity), "a bigint, b bigint")
    return materialize(found, "near-links")


def _small(df: DataFrame) -> DataFrame:
    """Broadcast within ``BROADCAST_KEYS`` rows, which are counted."""
    return F.broadcast(df) if df.count() <= BROADCAST_KEYS else df


def _with_roots(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` (with ``id``) and their ``root`` after these links: their own id where no link has it."""
    ends = materialize(components(links).where("node <> root").select(F.col("node").alias("id"), "root"), "near-roots")
    return rows.join(_small(ends), "id", "left").withColumn("root", F.coalesce("root", "id"))


def _live_rows(keyed: DataFrame) -> DataFrame:
    """``key, id, pos, root, n`` of the rows of ``keyed`` whose key more than one root has; ``n`` rows have the key.

    The grouping moves a key and three numbers for each row, combined on the map side. Keys of one root end there: what comes
    after is a small share.
    """
    least, most, n = F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")
    shared = materialize(keyed.groupBy("key").agg(least, most, n).where("low <> high").select("key", "n"), "near-keys")
    return materialize(keyed.select("key", "id", "pos", "root").join(_small(shared), "key"), "near-live")


def _first_pairs(live: DataFrame, sizes: DataFrame, similarity: float) -> DataFrame:
    """For each root the pair of one of its rows with the hub that it meets most often, if their lengths allow it.

    A key's hub is the row whose keys are the most frequent in all: of a group of copies the one that was changed least, so that
    most of the group is similar to it.
    """
    scores = live.groupBy("id").agg(F.sum("n").alias("score"))
    rows = live.select("key", "id", "root").join(scores, "id")
    hubs = rows.groupBy("key").agg(F.max_by("id", "score").alias("hub"), F.max_by("root", "score").alias("hub_root"))
    met = rows.join(hubs, "key").where("root <> hub_root").groupBy("id", "root", "hub").agg(F.count("*").alias("n"))
    best = met.groupBy("root").agg(F.max(F.struct("n", "hub", "id")).alias("m")).select(F.col("m.hub").alias("a"), F.col("m.id").alias("b"))
    for s in "ab":
        best = best.join(sizes.select(F.col("id").alias(s), F.col("size").alias(f"{s}_size")), s)
    similar = F.least("a_size", "b_size") >= similarity * F.greatest("a_size", "b_size") - 1e-6
    return best.where(similar & (F.col("a") != F.col("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _may_be_similar(similarity: float) -> Column:
    """What holds for any two sets of that similarity that share the shingles at ``a_pos`` and ``b_pos`` of their orders."""
    a, b, total = F.col("a_size"), F.col("b_size"), F.col("a_size") + F.col("b_size")
    lengths = F.least(a, b) >= similarity * F.greatest(a, b) - 1e-6
    rest = F.least(a - F.col("a_pos"), b - F.col("b_pos"))
    shared = F.least("a_pos", "b_pos") + rest >= similarity / (1 + similarity) * total - 1e-6
    differ = sum((F.bit_count(F.col(f"a_{w}").bitwiseXOR(F.col(f"b_{w}"))) for w in PARITY_COLUMNS), F.lit(0))
    return lengths & shared & (differ <= (1 - similarity) / (1 + similarity) * total + 1e-6)


def _enough_shared(similarity: float) -> Column:
    """What holds for any two sets of that similarity, where ``n`` is the number of shingles that their prefixes share.

    The prefix that ends first in the order leaves ceil(s * size) - 1 of its set; all that is shared before is in both prefixes.
    """
    a, b = F.col("a_size"), F.col("b_size")
    left = F.ceil(similarity * F.greatest(a, b) - 1e-6) - 1
    return F.col("n") + left >= similarity / (1 + similarity) * (a + b) - 1e-6


def _all_pairs(live: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs of rows with different roots that share a key, as far as the bounds allow them to be similar. None is left out.

    The keys that a pair shares are counted; only pairs with enough of them are returned.
    """
    sides = []
    facts = sets.select("id", "size", *PARITY_COLUMNS)
    rows = materialize(live.select("key", "id", "pos", "root").join(facts, "id"), "near-facts")
    for s in "ab":
        sides.append(rows.withColumnsRenamed({c: f"{s}_{c}" for c in rows.columns if c != "key"}))
    apart = (F.col("a_id") < F.col("b_id")) & (F.col("a_root") != F.col("b_root")) & _may_be_similar(similarity)
    met = sides[0].hint("merge").join(sides[1], "key").where(apart)
    counted = met.groupBy("a_id", "b_id", "a_size", "b_size").agg(F.count("*").alias("n"))
    return counted.where(_enough_shared(similarity)).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))


def _compared_in_rounds(pairs: DataFrame, links: DataFrame, compare: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``links`` and enough of ``pairs`` that are similar to give the components that all similar ones would.

    While there are many more pairs than roots, a share of them is compared, chosen by a hash; pairs whose roots are then the same
    need no comparison. Every other pair gets one in the end.
    """
    turn = 0
    while True:
        for s in "ab":
            pairs = _with_roots(pairs.withColumn("id", F.col(s)), links).withColumnRenamed("root", f"{s}_root").drop("id")
        pairs = materialize(pairs.where("a_root <> b_root"), "near-left")
        n, roots = pairs.agg(F.count("*"), F.approx_count_distinct("a_root")).first()
        share = 1.0 if n <= 8 * roots else 4 * roots / n
        drawn = F.pmod(F.xxhash64("a", "b", F.lit(turn)), F.lit(1 << 20)) < int(share * (1 << 20))
        links = links.union(compare(pairs.where(drawn).select("a", "b")))
        if share == 1.0:
            return links
        pairs, turn = pairs.where(~drawn).select("a", "b"), turn + 1


def near_copies(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8, distance: int = 4
) -> DataFrame:
    """``id, root`` of every row that is a near copy: those whose root, the smallest id reachable, is another row.

    Two texts are linked if their sets of ``width``-word shingles have that Jaccard similarity, compared exactly by their texts;
    no such link between different components is left out. Three steps find pairs to compare: the pigeonhole's groups, each row
    with the group's least; prefixes, each root with one other; prefixes, all pairs whose roots still differ. Rows with a null id,
    and texts without words, are nobody's copies; rows that repeat an id count as one document.
    """
    chosen = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).where("id is not null")
    common, counts = common_shingles(chosen, width)
    schema = ", ".join(["id bigint, fp bigint, size int", *(f"{w} bigint" for w in PARITY_COLUMNS), "prefix array<bigint>"])
    make = partial(_set_batches, width=width, similarity=similarity, common=common, counts=counts)
    sets = materialize(map_arrow(chosen, make, schema), "near-sets")
    prints = sets.select("id", "fp")
    grouped = prints.join(print_roots(prints.select("fp").distinct(), distance), "fp")
    least = grouped.groupBy("root").agg(F.min("id").alias("a"))
    links = _compared(grouped.join(least, "root").where("a <> id").select("a", F.col("id").alias("b")), chosen, width, similarity)
    rooted = _with_roots(sets.select("id", "prefix"), links)
    live = _live_rows(rooted.select("id", "root", F.posexplode("prefix").alias("pos", "key")))
    links = links.union(_compared(_first_pairs(live, sets, similarity), chosen, width, similarity))
    live = _live_rows(_with_roots(live.select("key", "id", "pos"), links))
    pairs = materialize(_all_pairs(live, sets, similarity), "near-candidates")
    links = _compared_in_rounds(pairs, links, partial(_compared, docs=chosen, width=width, similarity=similarity))
    return components(links).where("node <> root").select(F.col("node").alias("id"), "root").distinct()


def drop_near(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8, distance: int = 4
) -> DataFrame:
    """``docs`` without near copies: of each group the row with the smallest id stays. All its columns stay as they are."""
    gone = materialize(near_copies(docs, key, text, width, similarity, distance).select(F.col("id").alias("__id")), "near-gone")
    side = F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone
    return docs.join(side, docs[key].cast("bigint") == side["__id"], "left_anti")
