"""Sharding by a weighted hash tree, in DataFrame expressions only.

A tree has regions, racks and shards.  A node's weight is the sum of the weights below
it.  A row descends from the root: at each node every child draws ``-ln(u) / weight``,
where u in (0, 1) is hashed from the row's key and the child's name, and the least draw
wins.  A child wins with the share of its weight, and a change of weights moves rows
only between children whose weights changed; below them the draws decide as before.

Weight that is added later comes in generations.  A generation is a tree of its own over
the shards that gain: the root draws among the regions of all generations.  A row moves
when a new generation's region draws less than the old winner, and it then descends
through what that generation added.  So a new shard takes rows into itself only, the
right share of them from every old shard, and nothing else moves.

``place`` is a projection: it needs no shuffle, knows nothing of other rows, and no hot
key, source or text can disturb it.  ``slots`` numbers the rows of each shard without
gaps.  It groups equal rows before the shuffle, numbers them within (shard, bucket of the
key's hash), and adds the counts of the buckets before.

Defined cases: a null key counts as the empty one, so its rows share a shard, like those
of any other repeated key; repeated rows get slots of their own; a null text has no bytes.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.plans.ordered import running
from panelkit.session import settled

#: Racks and regions of ``even``; buckets in each shard by which ``slots`` numbers its rows.
RACKS, REGIONS, BUCKETS = 8, 4, 1024


@dataclass(frozen=True)
class Gain:
    """Weight that a shard gains in a generation; the first generation is 0."""

    shard: int
    rack: int
    region: int
    weight: float = 1.0
    generation: int = 0


def even(shards: int, base: int | None = None, weight: float = 1.0) -> list[Gain]:
    """Equal shards dealt over racks and regions in turn; each from ``base`` on came in a generation of its own."""
    base = shards if base is None else base
    return [Gain(s, s % RACKS, s % RACKS % REGIONS, weight, max(0, s - base + 1)) for s in range(shards)]


def _children(tree: Sequence[Gain]) -> dict[str, dict[str, float]]:
    """Name of a node -> names and weights of its children; shards are leaves named by their number."""
    below: dict = defaultdict(lambda: defaultdict(float))
    for g in tree:
        if g.weight <= 0:
            continue
        region, rack = f"g{g.generation}r{g.region}", f"g{g.generation}r{g.region}k{g.rack}"
        for node, child in (("root", region), (region, rack), (rack, f"{rack}s{g.shard}")):
            below[node][child] += g.weight
    return {node: dict(sorted(children.items())) for node, children in below.items()}


def _uniform(key: Column, name: Column) -> Column:
    """In (0, 1), by the first 32 bits of md5(key|name)."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", key, name)), 1, 8), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(4294967296.0)


def shard_of(key: Column, tree: Sequence[Gain]) -> Column:
    """Number of the shard of ``key``."""
    below = _children(tree)
    if not below:
        raise ValueError("a tree needs a shard of positive weight")
    key = F.coalesce(key.cast("string"), F.lit(""))

    def child(name: str, weight: float) -> Column:
        return F.struct(F.lit(name).alias("name"), F.lit(weight).alias("weight"))

    def table(nodes: list[str]) -> Column:
        pairs = [x for n in nodes for x in (F.lit(n), F.array(*[child(c, w) for c, w in below[n].items()]))]
        return F.create_map(*pairs)

    def step(children: Column) -> Column:
        draws = F.transform(children, lambda c: F.struct((-F.log(_uniform(key, c["name"])) / c["weight"]).alias("draw"), c["name"].alias("name")))
        return F.array_min(draws)["name"]

    regions = list(below["root"])
    racks = [r for region in regions for r in below[region]]
    node = step(F.array(*[child(c, w) for c, w in below["root"].items()]))
    for nodes in (regions, racks):
        node = step(F.element_at(table(nodes), node))
    return F.substring_index(node, "s", -1).cast("int")


def place(docs: DataFrame, tree: Sequence[Gain], key: str = "doc_id", column: str = "shard") -> DataFrame:
    """``docs`` with the shard of each row; a column of that name is replaced."""
    return docs.withColumn(column, shard_of(F.col(key), tree))


def slots(rows: DataFrame, key: str = "doc_id", shard: str = "shard", buckets: int = BUCKETS) -> DataFrame:
    """``rows`` with ``slot``, gapless from 0 in each shard; rows differ in ``key`` or count as repeated only if all columns are equal."""
    kept = rows.columns
    groups = rows.groupBy(*kept).agg(F.count(F.lit(1)).alias("_times"))
    hashed = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")
    groups = groups.withColumn("_bucket", hashed % F.lit(buckets))
    order = F.struct(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), *[F.col(c) for c in kept if c not in (key, shard)])
    placed = running(groups.withColumn("_order", order), [shard], "_bucket", "_order", {"_upto": F.col("_times")})
    first = F.col("_upto") - F.col("_times")
    return placed.select(*kept, F.explode(F.sequence(first, F.col("_upto") - 1)).alias("slot"))


def assign(docs: DataFrame, shards: int) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row, for equal shards.

    ``grown_shard`` is the shard if there were one more.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    facts = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    facts = place(facts, even(shards))
    facts = place(facts, even(shards + 1, base=shards), column="grown_shard")
    facts = settled(facts, "shard-facts")  # numbering reads them twice, the texts once
    numbered = slots(facts)
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
