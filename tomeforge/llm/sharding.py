"""Sharding by a hierarchical weighted hash tree.

Each key descends region, rack and shard levels. At a level every child of the node
reached so far draws ``ln(u) / weight`` with ``u`` hashed from (seed, child, key), and
the largest draw wins. Draws of different children are independent and a child's draw
depends on its own weight alone, so a changed weight moves keys only into or out of the
subtree that holds it, and the share of keys that a child gets is its share of weight.
An inner node weighs what its shards weigh together.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeforge.llm.common import free_name, refuse_names

Topology = Mapping[str, Mapping[str, Mapping[str, float]]]

#: Three regions of unequal size; one rack holds larger disks.
PRODUCTION: Topology = {
    "east": {
        "e1": {"e1a": 1.0, "e1b": 1.0, "e1c": 1.0, "e1d": 1.0},
        "e2": {"e2a": 1.0, "e2b": 1.0, "e2c": 1.0, "e2d": 1.0},
        "e3": {"e3a": 2.0, "e3b": 2.0},
    },
    "north": {
        "n1": {"n1a": 1.5, "n1b": 1.5, "n1c": 1.5},
        "n2": {"n2a": 1.0, "n2b": 1.0, "n2c": 0.5},
    },
    "west": {
        "w1": {"w1a": 1.0, "w1b": 1.0},
        "w2": {"w2a": 1.0, "w2b": 3.0},
    },
}


def _weight(node) -> float:
    return float(node) if not isinstance(node, Mapping) else sum(map(_weight, node.values()))


def _draw(key: Column, path: str, weight: float, seed: int) -> Column:
    # 52 bits of an md5: exact in a double, and the same number in any SQL engine
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/{path}/"), key)), 1, 13), 16, 10).cast("double")
    return F.log((bits + 1.0) / F.lit(float(2**52 + 1))) / F.lit(weight)


def _choose(key: Column, prefix: str, children: Mapping, seed: int) -> Column:
    """The winning child's name; of equal draws the first in name order wins."""
    alive = [(name, _weight(node)) for name, node in sorted(children.items()) if _weight(node) > 0]
    if not alive:
        return F.lit(None).cast("string")
    if len(alive) == 1:
        return F.lit(alive[0][0])
    best = F.greatest(*(draws := [_draw(key, f"{prefix}{name}", w, seed) for name, w in alive]))
    out = F.when(draws[0] == best, F.lit(alive[0][0]))
    for (name, _), draw in list(zip(alive, draws))[1:]:
        out = out.when(draw == best, F.lit(name))
    return out


def assign_shards(frame: DataFrame, topology: Topology = PRODUCTION, key_col: str = "doc_id", seed: int = 1) -> DataFrame:
    """(key, region, rack, shard) for every row; a projection, with no shuffle.

    * A null key is placed as the key ``null``. Repeated rows go to the same shard and stay
      repeated. An empty table gives an empty result. Other columns are not read.
    * Nodes of weight 0 get nothing; a topology without weight gives null levels.
    * Of equal draws the first name in order wins. Negative weights raise ``ValueError``, and so does a
      key column that is called like a level.
    """
    for racks in topology.values():
        for shards in racks.values():
            if any(w < 0 for w in shards.values()):
                raise ValueError("weights must not be negative")
    refuse_names(key_col, "region", "rack", "shard")
    key = F.coalesce(F.col(key_col).cast("string"), F.lit("null"))
    hashed = free_name("_hashed", frame)
    out = frame.select(F.col(key_col), key.alias(hashed))
    out = out.withColumn("region", _choose(F.col(hashed), "", topology, seed))
    rack = shard = None
    for region, racks in sorted(topology.items()):
        pick = _choose(F.col(hashed), f"{region}/", racks, seed)
        rack = F.when(F.col("region") == region, pick) if rack is None else rack.when(F.col("region") == region, pick)
    out = out.withColumn("rack", rack if rack is not None else F.lit(None).cast("string"))
    for region, racks in sorted(topology.items()):
        for name, shards in sorted(racks.items()):
            here = (F.col("region") == region) & (F.col("rack") == name)
            pick = _choose(F.col(hashed), f"{region}/{name}/", shards, seed)
            shard = F.when(here, pick) if shard is None else shard.when(here, pick)
    return out.select(key_col, "region", "rack", (shard if shard is not None else F.lit(None).cast("string")).alias("shard"))


def sql(topology: Topology = PRODUCTION, table: str = "documents", key_col: str = "doc_id", seed: int = 1) -> str:
    """The same assignment in DuckDB, by arg_max over an explicit list of nodes."""
    nodes = []
    for region, racks in topology.items():
        nodes.append((1, "", region, _weight(racks)))
        for rack, shards in racks.items():
            nodes.append((2, f"{region}/", rack, _weight(shards)))
            nodes.extend((3, f"{region}/{rack}/", shard, float(w)) for shard, w in shards.items())
    values = ", ".join(f"({level}, '{prefix}', '{name}', {w!r}::DOUBLE)" for level, prefix, name, w in nodes if w > 0)
    draw = f"ln((('0x' || substr(md5('{seed}/' || n.prefix || n.name || '/' || k.k), 1, 13))::BIGINT::DOUBLE + 1.0) / {float(2**52 + 1)!r}::DOUBLE) / n.w"
    level = lambda i, src, prefix: (
        f"SELECT k.*, (SELECT arg_max(n.name, {draw}) FROM nodes n WHERE n.level = {i} AND n.prefix = {prefix}) AS n{i} FROM {src} k"
    )
    return f"""
    WITH nodes(level, prefix, name, w) AS (VALUES {values}),
    keys AS (SELECT {key_col}, coalesce({key_col}::VARCHAR, 'null') AS k FROM {table}),
    one AS ({level(1, 'keys', "''")}),
    two AS ({level(2, 'one', "k.n1 || '/'")}),
    three AS ({level(3, 'two', "k.n1 || '/' || k.n2 || '/'")})
    SELECT {key_col}, n1 AS region, n2 AS rack, n3 AS shard FROM three"""
