"""Mixing sources to target weights: exact block quotas split down a tree of output shards."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitegrid.operators.skew import skew_join
from sitegrid.session import dropped, written

#: Tokens of an output shard and of a block, which goes to one shard as a whole.
SHARD_TOKENS, BLOCK_TOKENS = 1_000_000, 16_384
#: Shards of a subtree, whose quotas one task makes.
SUBTREE_SHARDS = 1_024
#: Rows of a source that are ordered in one task.
BUCKET_ROWS = 100_000
#: Rows of a source that are looked at together for those that fill its quota up, and the share of the quota that may be left.
FILLERS, SLACK = 1_024, 0.0005
#: Most balls the library draws from exactly.
EXACT_DRAWS = 900_000_000
SEED = 20260805


@dataclass(frozen=True)
class Share:
    """How one source is used: ``full`` times as a whole, then ``rest`` tokens of its random order."""

    source: str
    target: float
    repeats: int
    size: int
    quota: int

    @property
    def full(self) -> int:
        return min(self.quota // self.size, self.repeats)

    @property
    def rest(self) -> int:
        return self.quota - self.full * self.size if self.full < self.repeats else 0

    def blocks(self, block: int) -> int:
        return self.full * -(-self.size // block) + -(-self.rest // block)


def shares_of(sizes: dict[str, int], targets: list[tuple[str, float, int]], total: int | None = None) -> list[Share]:
    """Quotas for the largest total (or ``total``, if less) at which no source is repeated beyond its cap.

    A source without tokens, without a positive share or repeats can't contribute: it is left out and the shares of the
    others keep their proportion. No source at all gives no shares.
    """
    usable = [(s, t, r) for s, t, r in targets if s is not None and t and t > 0 and r and r > 0 and sizes.get(s)]
    weight = sum(t for _, t, _ in usable)
    if not usable:
        return []
    most = min(r * sizes[s] * weight / t for s, t, r in usable)
    total = most if total is None else min(total, most)
    return [Share(s, t, r, sizes[s], min(int(total * t / weight), r * sizes[s])) for s, t, r in sorted(usable)]


def _drawn(have: np.ndarray, take: int, rng: np.random.Generator) -> np.ndarray:
    """One draw from the multivariate hypergeometric distribution.

    Beyond EXACT_DRAWS balls, source after source from the normal distribution of the same mean and variance, kept within
    what is possible: the sum is exact in any case.
    """
    total = int(have.sum())
    if total <= EXACT_DRAWS:
        return rng.multivariate_hypergeometric(have, take, method="marginals") if take else np.zeros_like(have)
    out, left = np.zeros_like(have), take
    for i, n in enumerate(have.tolist()):
        rest = total - n
        share = n / max(total, 1)
        spread = left * share * (1 - share) * (total - left) / max(total - 1, 1)
        out[i] = min(max(round(rng.normal(left * share, max(spread, 0.0) ** 0.5)), left - rest, 0), n, left)
        left, total = left - int(out[i]), rest
    return out


def _halves(low: int, high: int, have: np.ndarray, before: np.ndarray, seed: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """The two halves of a node: their shards, their blocks per source, and the blocks of all shards before them."""
    mid = (low + high) // 2
    take = int(have.sum()) * (mid - low) // (high - low)
    left = _drawn(have, take, np.random.default_rng([seed, low, high]))
    return [(low, mid, left, before), (mid, high, have - left, before + left)]


def subtree_quotas(blocks: list[int], shards: int, seed: int, path: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``shard, blocks per source, blocks of the shards before it`` for the shards below the node that ``path`` (0: left,
    1: right) leads to from the root.

    A node of the tree holds some shards and a number of blocks per source; what its left half gets is one draw from the
    multivariate hypergeometric distribution, the right half gets the rest. So each shard's mix is that of a random draw
    without replacement, sizes of shards differ by a block a level, and the whole is exact. A node's draw depends on the
    seed and its place only, so any task can make its part of the tree alone.
    """
    have = np.asarray(blocks, np.int64)
    node = (0, shards, have, np.zeros_like(have))
    for turn in path:
        if node[1] - node[0] == 1:  # a leaf above the others: its first path takes it
            if turn:
                return
            continue
        node = _halves(*node, seed)[turn]
    stack = [node]
    while stack:
        low, high, have, before = stack.pop()
        if high - low == 1:
            yield low, have, before
        else:
            stack += _halves(low, high, have, before, seed)


def split_quotas(blocks: list[int], shards: int, seed: int) -> np.ndarray:
    """Blocks of each source for each shard: ``shards`` rows that sum to ``blocks``."""
    out = np.zeros((shards, len(blocks)), np.int64)
    for shard, have, _ in subtree_quotas(blocks, shards, seed, []):
        out[shard] = have
    return out


def _affine(n: int, seed: int, of: int) -> tuple[int, int]:
    """A step without a common divisor with n and an offset: b -> (step * b + offset) mod n permutes the blocks."""
    rng = np.random.default_rng([seed, of])
    step = int(rng.integers(1, max(n, 2)))
    while gcd(step, n) != 1:
        step = step % n + 1
    return step, int(rng.integers(0, n))


def _slots(spark, names: list[str], blocks: list[int], shards: int, seed: int) -> DataFrame:
    """``source, slot, shard``: which shard each place of a source's permuted blocks belongs to, made by subtrees in tasks."""
    depth = max(0, (shards - 1) // SUBTREE_SHARDS).bit_length()
    shared = spark.sparkContext.broadcast((names, blocks))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sources, counts = shared.value
        for b in batches:
            for number in b.column("id").to_pylist():
                for shard, have, before in subtree_quotas(counts, shards, seed, [number >> k & 1 for k in reversed(range(depth))]):
                    some = np.flatnonzero(have)
                    yield pa.RecordBatch.from_arrays([pa.array([sources[i] for i in some], pa.string()), pa.array(before[some]), pa.array((before + have)[some]), pa.array(np.full(len(some), shard, np.int64))], names=["source", "low", "high", "shard"])

    ranges = spark.range(0, 1 << depth, 1, min(1 << depth, 4096)).mapInArrow(made, "source string, low long, high long, shard long")
    return ranges.select("source", "shard", F.explode(F.sequence("low", F.col("high") - 1)).alias("slot"))


def _fillers(behind: DataFrame, gaps: dict[str, tuple[int, int, int]]) -> list[tuple[str, int, int, int]]:
    """``source, h, use, at`` of rows that fill quotas up: of the next FILLERS rows that fit, the largest first, and so on
    until no row fits or the rest is slight. ``gaps``: where a source's gap begins, its size and the size that may be left.

    A gap is less than one row, so the rows to look at are few, whatever the source's size.
    """
    out, spark = [], behind.sparkSession
    beyond = dict.fromkeys(gaps, -1)
    while beyond:
        wanted = spark.createDataFrame([(s, gaps[s][1], at) for s, at in beyond.items()], "source string, gap long, beyond long")
        rank = F.row_number().over(Window.partitionBy("source").orderBy("at"))
        rows = behind.join(F.broadcast(wanted), "source").where((F.col("n_tokens") <= F.col("gap")) & (F.col("at") > F.col("beyond"))).withColumn("r", rank).where(F.col("r") <= FILLERS)
        found: dict[str, list] = {}
        for r in rows.select("source", "h", "use", "n_tokens", "at").collect():
            found.setdefault(r["source"], []).append(r)
        beyond = {}
        for source, some in found.items():
            start, gap, slack = gaps[source]
            for r in sorted(some, key=lambda r: (-r["n_tokens"], r["h"])):
                if r["n_tokens"] <= gap:
                    out.append((source, r["h"], r["use"], start))
                    start, gap = start + r["n_tokens"], gap - r["n_tokens"]
            gaps[source] = (start, gap, slack)
            if gap > slack and len(some) == FILLERS:
                beyond[source] = max(r["at"] for r in some)
    return out


def mix_sources(sizes: DataFrame, targets: DataFrame, key: str, source: str = "source", total: int | None = None, shard_tokens: int = SHARD_TOKENS, block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> DataFrame:
    """The mix as ``key, source, copy, shard, position, n_tokens``, one row per use of a row of ``sizes``.

    ``sizes``: key, source, n_tokens; ``targets``: source, target_share, max_repeats, whose rows (a hundred bytes a source)
    are read to the driver. Rows of other or no sources and rows without tokens aren't used.

    Equal rows are counted and numbered, so a source's rows get a random order by unlike hashes, whatever repeats; the
    order is cut into buckets, whose sums give every row its place in tokens without putting a source into one task. Whole
    repeats take all rows, the remainder the first ones that fit into the quota; where the next is larger than what is
    left, rows behind it fill the gap. So no source exceeds its quota, and it falls short by a slight part of it, or by
    less than its least unused row. Consecutive tokens form blocks; tasks split the block quotas among
    shards, each a subtree of its own; the shards draw disjoint runs of a permutation of each source's blocks; rows are
    shuffled inside their shard, which holds about ``shard_tokens`` whatever the total. Rows with equal key are used each.
    """
    spark = sizes.sparkSession
    goals = [(r["source"], float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in targets.select("source", "target_share", "max_repeats").collect()]
    wanted = targets.select(F.col("source").alias("__source")).dropna().distinct()
    some = sizes.where(F.col("n_tokens") > 0).select(F.col(key).alias("key"), F.col(source).alias("source"), F.col("n_tokens").cast("long").alias("n_tokens"))
    # equal rows combine on the map side; so do all rows of a source in its totals
    used = written(some.groupBy("key", "source", "n_tokens").agg(F.count(F.lit(1)).alias("uses")).join(wanted, F.col("source") == F.col("__source"), "left_semi"), "mix-rows")
    totals = {r["source"]: (r["tokens"], r["n"]) for r in used.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.sum("uses").alias("n")).collect()}
    shares = shares_of({s: t for s, (t, _) in totals.items()}, goals, total)
    kind = sizes.schema[key].dataType.simpleString()
    if not shares:
        return spark.createDataFrame([], f"{key} {kind}, source string, copy int, shard long, position int, n_tokens long")
    shards = max(1, round(sum(s.quota for s in shares) / shard_tokens))
    counts = [s.blocks(block_tokens) for s in shares]
    plans = []
    for i, s in enumerate(shares):
        n = max(1, counts[i])
        plans.append((s.source, -(-totals[s.source][1] // BUCKET_ROWS), s.full, s.rest, -(-s.size // block_tokens), n, *_affine(n, seed, i)))
    plan = spark.createDataFrame(plans, "source string, buckets long, full int, rest long, per_copy long, blocks long, step long, shift long")
    each = used.select("key", "source", "n_tokens", F.explode(F.sequence(F.lit(1).cast("long"), F.col("uses"))).alias("use"))
    hashed = skew_join(each, plan, ["source"]).withColumn("h", F.xxhash64(F.lit(seed), "key", "n_tokens", "use")).withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 40), F.col("buckets")))
    sums = hashed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("s"))
    before = sums.select("source", "bucket", (F.sum("s").over(Window.partitionBy("source").orderBy("bucket")) - F.col("s")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("source", "bucket").orderBy("h", "key", "use").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    placed = hashed.withColumn("inside", inside).join(before, ["source", "bucket"])
    placed = written(placed.select("key", "source", "n_tokens", "use", "h", "full", "rest", "per_copy", "blocks", "step", "shift", (F.col("before") + F.col("inside")).alias("at")), "mix-places")
    fits = F.col("at") + F.col("n_tokens") <= F.col("rest")
    taken = {r["source"]: r["t"] for r in placed.where(fits).groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    gaps = {s.source: (taken.get(s.source, 0), s.rest - taken.get(s.source, 0), int(SLACK * s.quota)) for s in shares if s.rest > taken.get(s.source, 0)}
    fill = spark.createDataFrame(_fillers(placed.where(~fits), gaps), "source string, h long, use long, fill_at long")
    copies = F.col("full") + fits.cast("int")
    draws = placed.where(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1)))
    filled = placed.where(~fits).join(fill, ["source", "h", "use"]).withColumn("at", F.col("fill_at")).withColumn("copy", F.col("full")).select(*draws.columns)
    block = F.least(F.col("copy") * F.col("per_copy") + F.floor(F.col("at") / block_tokens), F.col("blocks") - 1)
    spread = draws.unionByName(filled).withColumn("slot", F.pmod(block * F.col("step") + F.col("shift"), F.col("blocks"))).join(_slots(spark, [s.source for s in shares], counts, shards, seed), ["source", "slot"])
    order = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 1), "h", "copy"), "h", "key", "use", "copy")
    dropped(used)
    return spread.select(F.col("key").alias(key), "source", "copy", "shard", (F.row_number().over(order) - 1).alias("position"), "n_tokens")


def mix_report(mix: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """Shares reached: ``source, target_share, max_repeats, actual_share, n_tokens, n_rows, n_keys, most_repeats``."""
    uses = mix.groupBy("source", key).agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n"))
    by = uses.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"), F.max("n").alias("most_repeats"))
    joined = targets.select("source", "target_share", "max_repeats").join(by, "source", "left")
    whole = F.sum("n_tokens").over(Window.partitionBy())  # a row per source
    return joined.select("source", "target_share", "max_repeats", F.coalesce(F.col("n_tokens") / F.nullif(whole, F.lit(0)), F.lit(0.0)).alias("actual_share"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_tokens", "n_rows", "n_keys", "most_repeats")])
