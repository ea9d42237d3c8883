"""Sharding by a hierarchical weighted hash tree.

The tree has regions, racks and shards. At each level a key draws one number per child from a hash
of (key, path of the child) and takes the child with the least ``-ln(u) / weight``; the chance of a
child is its share of the weights. A child whose weight does not change keeps its draw, so a change
of weights moves rows only into subtrees that gain and out of subtrees that lose.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered

SHARDS = 24
#: Shards of a rack and racks of a region in the regular tree.
RACK, REGION = 4, 2


@dataclass(frozen=True)
class Node:
    """A leaf carries a shard and a weight; an inner node weighs what its children weigh."""

    path: str
    shard: int | None = None
    own: float = 0.0
    children: tuple[Node, ...] = field(default=())

    @property
    def weight(self) -> float:
        return self.own if self.shard is not None else sum(c.weight for c in self.children)


def build(leaves: list[tuple[str, str, int, float]]) -> Node:
    """Tree from (region, rack, shard, weight); weights of zero or less are refused."""
    if not leaves or any(w <= 0 for *_, w in leaves):
        raise ValueError("a tree needs at least one shard, and positive weights")
    regions: dict[str, dict[str, list[Node]]] = {}
    for region, rack, shard, weight in leaves:
        regions.setdefault(region, {}).setdefault(rack, []).append(Node(f"{region}/{rack}/{shard}", shard, float(weight)))
    return Node("", children=tuple(
        Node(r, children=tuple(Node(f"{r}/{k}", children=tuple(nodes)) for k, nodes in racks.items())) for r, racks in regions.items()
    ))


def regular(shards: int = SHARDS, grown: int = 0) -> list[tuple[str, str, int, float]]:
    """Equal shards in racks of four and regions of two racks; each added shard is a region of its own.

    A weight that rises inside a region would also draw rows to the region's older shards. As a region
    of its own an added shard is the only subtree that gains, so rows move into it and nowhere else.
    """
    base = [(f"r{i // (RACK * REGION)}", f"k{i // RACK % REGION}", i, 1.0) for i in range(shards)]
    return base + [(f"added{i}", "k0", i, 1.0) for i in range(shards, shards + grown)]


def _draw(key: Column, node: Node) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(node.path)), 11)
    return -F.log((bits.cast("double") + 0.5) / float(1 << 53)) / F.lit(node.weight)


def descend(key: Column, node: Node) -> Column:
    """Shard of a key: one draw per child at each level on the way down."""
    if node.shard is not None:
        return F.lit(node.shard)
    if len(node.children) == 1:
        return descend(key, node.children[0])
    won = F.array_min(F.array(*[F.struct(_draw(key, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(node.children)]))["i"]
    if all(c.shard is not None for c in node.children):
        return F.element_at(F.array(*[F.lit(c.shard) for c in node.children]), won + 1)
    taken = F.transform(F.array(won), lambda w: _pick(key, node, w))
    return F.element_at(taken, 1)


def _pick(key: Column, node: Node, won: Column) -> Column:
    out = None
    for i, c in enumerate(node.children):
        branch = descend(key, c)
        out = F.when(won == i, branch) if out is None else out.when(won == i, branch)
    return out


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Put every row into a shard; doc_id and the number of shards decide.

    Returns doc_id, size (UTF-8 bytes of the text, none if null, plus 8), text_crc32 (null for a null
    text), law, shard, slot (place within the shard, from 0 without a gap; order: hash cell of doc_id,
    doc_id), grown_shard (with one shard more). Rows with a null doc_id share one shard, as do rows
    that repeat a doc_id. Further columns of the input are left out.
    """
    key = F.col("doc_id")
    text = F.col("text")
    rows = docs.select(
        key,
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        descend(key, build(regular(shards))).cast("int").alias("shard"),
        descend(key, build(regular(shards, 1))).cast("int").alias("grown_shard"),
    )
    out = numbered(rows, "shard", "doc_id", "slot")
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
