"""K-d tree sharding: split at distributed weighted medians along the widest metadata dimension.

The unit of a split is a group of equal texts, which stays whole up to a shard's share; only a larger one is dealt out,
in parts of a sixteenth of a share, so no group can unbalance a shard. A unit above 1/64 of a share is heavy. Heavy
units (at most 64 for each shard) are placed first, each on the side of the cut that holds the most of it, or on the
other where the goal needs it; then the others' median is set to what these leave of the goal, so that heavy groups do
not unbalance shards either.

Every level of the tree is one pass for the extents of all its nodes and a few passes for the medians: each narrows all
nodes' medians at once by a histogram of 1,024 bins a node, so the driver sees at most shards x bins counts, whatever the
input. Keys end in bits of a hash, so ties in a dimension (a source with a third of all rows) are split too. Only ids,
sizes and hashes are shuffled, never texts.

Cases: a null or empty text has no bytes and the fixed cost alone. Null metadata, ids included, counts as 0, the lowest
value but for negative ids; an id that is no number counts by its hash. Repeated rows are separate rows of one group. An
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import cut, pick

BINS = 1024
LEVEL_BITS = 10
KEY_BITS = 40
VALUE_BITS = 20
DIMS = ("d_size", "d_id", "d_source", "d_lang")
ROW_BYTES = 8
#: A unit above 1/HEAVY of a shard's share is heavy.
HEAVY = 64
RULE = "node int, step int, dim int, lo double, width double"


def shard_count(total_bytes: int, target_bytes: int) -> int:
    """Leaves that bring each to target_bytes at most."""
    return max(1, math.ceil(total_bytes / max(1, target_bytes)))


def _units(docs: DataFrame, id_col: str, text_col: str, shards: int) -> tuple[DataFrame, DataFrame, int]:
    """(documents with their unit; units with weight, dimensions and hash bits; weight of all); texts end here."""
    slim = pick(docs, doc_id=id_col, text=text_col, source="source", lang="lang")
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length(text)
    number = F.col("doc_id").cast("string").try_cast("double")
    by_hash = F.xxhash64("doc_id").bitwiseAND(0xFFFFF).cast("double")
    slim = cut(
        slim.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            (size + ROW_BYTES).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text, F.crc32(text.cast("binary")), size).alias("group"),
            F.when(F.col("doc_id").isNull(), 0.0).otherwise(F.greatest(F.lit(-1e300), F.least(F.lit(1e300), F.coalesce(number, by_hash)))).alias("id"),
            F.coalesce(F.xxhash64("source").bitwiseAND(0xFFFFF), F.lit(0)).alias("src"),
            F.coalesce(F.xxhash64("lang").bitwiseAND(0xFFFFF), F.lit(0)).alias("lng"),
        )
    )
    total = slim.agg(F.sum("size")).first()[0] or 0
    share = max(1, total // shards)
    # Groups above a shard's share: fewer than there are shards.
    parts = {r["group"]: math.ceil(16 * r["w"] / share) for r in slim.groupBy("group").agg(F.sum("size").alias("w")).where(F.col("w") > share).collect()}
    part = F.lit(0)
    if parts:
        wide = docs.sparkSession.createDataFrame(list(parts.items()), "group long, parts int")
        slim = slim.join(F.broadcast(wide), "group", "left")
        part = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("row"), F.col("parts"))).otherwise(0)
    slim = slim.withColumn("unit", F.when(part == 0, F.col("group")).otherwise(F.xxhash64("group", part))).drop("parts", "group")
    units = slim.groupBy("unit").agg(
        F.sum("size").alias("w"),
        F.log2(F.max("size").cast("double")).alias("d_size"),
        F.min("id").alias("d_id"),
        F.min("src").cast("double").alias("d_source"),
        F.min("lng").cast("double").alias("d_lang"),
    )
    return slim, units.select("unit", "w", F.array(*DIMS).alias("dims"), F.xxhash64("unit", F.lit(7)).bitwiseAND((1 << (KEY_BITS - VALUE_BITS)) - 1).alias("low")), total


class Heavy:
    """A heavy unit, kept by the driver: there are at most HEAVY for each shard."""

    def __init__(self, row):
        self.unit, self.w, self.dims, self.low, self.node = row["unit"], row["w"], list(row["dims"]), row["low"], 0

    def key(self, rule: tuple) -> int:
        """What _keyed gives."""
        _, _, dim, lo, width = rule
        top = (1 << VALUE_BITS) - 1
        return (min(top, max(0, math.floor((self.dims[dim] - lo) / width * top))) << (KEY_BITS - VALUE_BITS)) + self.low


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row; shards, or as many as target_bytes needs."""
    spark = docs.sparkSession
    if shards is None:
        total = docs.agg(F.sum(F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)) + ROW_BYTES)).first()[0] or 0
        shards = shard_count(total, target_bytes or 1 << 30)
    slim, units, total = _units(docs, id_col, text_col, shards)
    units = cut(units)
    heavy = [Heavy(r) for r in units.where(F.col("w") * (HEAVY * shards) > total).collect()]
    light = units.where(F.col("w") * (HEAVY * shards) <= total)
    extent = [f(F.col("dims")[i]).alias(f"{n}{i}") for i in range(len(DIMS)) for n, f in (("lo", F.min), ("hi", F.max))]
    spread: list[float] = []

    # node: the first leaf of a node's range; leaves and before: how many leaves and how much weight to its left.
    leaves, before = {0: shards}, {0: 0}
    placed = light.withColumn("node", F.lit(0))
    while any(n > 1 for n in leaves.values()):
        open_nodes = [k for k, n in leaves.items() if n > 1]
        live = placed.where(F.col("node").isin(open_nodes))
        boxes = {r["node"]: ([r[f"lo{i}"] for i in range(len(DIMS))], [r[f"hi{i}"] for i in range(len(DIMS))]) for r in live.groupBy("node").agg(*extent).collect()}
        for h in heavy:
            lo, hi = boxes.get(h.node, (h.dims, h.dims))
            boxes[h.node] = [min(a, b) for a, b in zip(lo, h.dims, strict=True)], [max(a, b) for a, b in zip(hi, h.dims, strict=True)]
        level: dict[int, tuple] = {}
        for k in open_nodes:
            lo, hi = boxes.get(k, ([0.0] * len(DIMS),) * 2)
            spread = spread or [max(1e-9, b - a) for a, b in zip(lo, hi, strict=True)]  # of the whole, at the first level
            dim = max(range(len(DIMS)), key=lambda i, lo=lo, hi=hi: ((hi[i] - lo[i]) / spread[i], -i))
            level[k] = (k, leaves[k] // 2, dim, float(lo[dim]), float(max(1e-9, hi[dim] - lo[dim])))
        rules = spark.createDataFrame(list(level.values()), RULE)
        # A goal is a share of the whole, so that errors of a unit's size do not add up from level to level.
        goals = {k: total * (k + leaves[k] // 2) / shards - before[k] for k in open_nodes}
        cuts, left_w = _medians(_keyed(live, rules), goals, level, [h for h in heavy if h.node in level])
        bounds = spark.createDataFrame([(*level[k], cuts[k]) for k in open_nodes], f"{RULE}, cut long")
        moved = _keyed(placed, bounds, "left").withColumn("node", F.col("node") + F.when(F.col("key") >= F.col("cut"), F.col("step")).otherwise(0))
        placed = cut(moved.select("unit", "w", "dims", "low", "node"))
        for k in open_nodes:
            left = leaves[k] // 2
            before[k + left] = before[k] + left_w[k]
            leaves[k], leaves[k + left] = left, leaves[k] - left
    placed = placed.select("unit", F.col("node").cast("int").alias("shard"))
    if heavy:
        placed = placed.unionByName(spark.createDataFrame([(h.unit, h.node) for h in heavy], "unit long, shard int"))
    return _slots(slim.join(placed, "unit"))


def _keyed(units: DataFrame, rules: DataFrame, how: str = "inner") -> DataFrame:
    """units with a key: the value's place in its node's extent along the node's dimension, then bits of the unit's
    hash; KEY_BITS bits in all. rules has a row a node, shards at most."""
    top = (1 << VALUE_BITS) - 1
    value = F.floor((F.get("dims", F.col("dim")) - F.col("lo")) / F.col("width") * top).cast("long")
    key = F.shiftleft(F.least(F.lit(top), F.greatest(F.lit(0), value)).cast("long"), KEY_BITS - VALUE_BITS) + F.col("low")
    return units.join(F.broadcast(rules), "node", how).withColumn("key", key)


def _medians(keyed: DataFrame, goals: dict[int, float], rules: dict[int, tuple], heavy: list[Heavy]) -> tuple[dict[int, int], dict[int, int]]:
    """For each node the key at which the weight below is nearest to the goal, and that weight, by narrowing
    histograms of the light units: at most nodes x BINS counts reach the driver at a time. The first of these also
    places the heavy units, whose node becomes that of their side."""
    goals, base, below, placed = dict(goals), {k: 0 for k in goals}, {k: 0 for k in goals}, {k: 0 for k in goals}
    spark = keyed.sparkSession
    for step in range(KEY_BITS // LEVEL_BITS):
        shift = KEY_BITS - LEVEL_BITS * (step + 1)
        prefixes = spark.createDataFrame(list(base.items()), "node int, prefix long")
        inside = keyed.join(F.broadcast(prefixes), "node").where(F.shiftright("key", shift + LEVEL_BITS) == F.col("prefix"))
        counts: dict[int, dict[int, int]] = {k: {} for k in goals}
        for r in inside.groupBy("node", F.shiftright("key", shift).bitwiseAND(BINS - 1).alias("bin")).agg(F.sum("w").alias("w")).collect():
            counts[r["node"]][r["bin"]] = r["w"]
        if step == 0:
            for node, units in _by_node(heavy).items():
                before, left, right = 0, [], []
                for h in sorted(units, key=lambda h: (h.key(rules[h.node]), h.unit)):
                    under = before + sum(w for b, w in counts[node].items() if b < h.key(rules[node]) >> shift)
                    before += h.w
                    (left if under + h.w / 2 <= goals[node] else right).append(h)
                _even_out(left, right, goals[node] - sum(counts[node].values()), goals[node])
                for h in right:
                    h.node += rules[node][1]
                placed[node] = sum(h.w for h in left)
                goals[node] = max(0, goals[node] - placed[node])
        last = shift == 0
        for k, goal in goals.items():
            at = 0
            for b in sorted(counts[k]):
                at = b
                if below[k] + counts[k][b] > goal:
                    if last and below[k] + counts[k][b] - goal < goal - below[k]:
                        below[k] += counts[k][b]
                        at += 1
                    break
                if last or b != max(counts[k]):
                    below[k] += counts[k][b]
                    at += last
            base[k] = (base[k] << LEVEL_BITS) + at
    return base, {k: below[k] + placed[k] for k in goals}


def _even_out(left: list[Heavy], right: list[Heavy], least: float, most: float) -> None:
    """Moves heavy units across a cut while that brings the weight to its left nearer to least..most, the weights that
    light units can make up for; the unit whose weight is nearest to what is needed goes."""
    while True:
        weight = sum(h.w for h in left)
        need = weight - most if weight > most else least - weight
        here, there = (left, right) if weight > most else (right, left)
        able = [h for h in here if h.w < 2 * need]
        if need <= 0 or not able:
            return
        best = min(able, key=lambda h: (abs(h.w - need), h.unit))
        here.remove(best)
        there.append(best)


def _by_node(heavy: list[Heavy]) -> dict[int, list[Heavy]]:
    out: dict[int, list[Heavy]] = {}
    for h in heavy:
        out.setdefault(h.node, []).append(h)
    return out


def _slots(df: DataFrame) -> DataFrame:
    """Gapless slots in each shard without a window over a whole shard: rows are sorted in ranges, and each range
    adds the rows that earlier ranges hold of its shard."""
    ranged = cut(df.select("row", "doc_id", "size", "text_crc32", "shard").repartitionByRange("shard", "doc_id", "row").sortWithinPartitions("shard", "doc_id", "row").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    runs = ranged.groupBy("shard", part.alias("part")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).collect()
    offsets, seen = [], {}
    for r in sorted(runs, key=lambda r: (r["shard"], r["part"])):  # at most partitions + shards rows
        offsets.append((r["shard"], r["part"], seen.get(r["shard"], 0) - r["first"]))
        seen[r["shard"]] = seen.get(r["shard"], 0) + r["n"]
    shifts = df.sparkSession.createDataFrame(offsets, "shard int, part long, shift long")
    return ranged.withColumn("part", part).join(F.broadcast(shifts), ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("at") + F.col("shift")).alias("slot"))
