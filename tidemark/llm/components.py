"""Connected components of a graph whose edges are too many for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: A key with more than one in ``SHARES`` of all rows is dealt over several tasks; there are fewer than ``SHARES`` such keys.
SHARES = 128


def frequent(counts: DataFrame, key: str) -> dict[object, int]:
    """Of (key, n), the keys with more than one in ``SHARES`` of all, and into how many parts each is dealt."""
    whole = counts.agg(F.sum("n").alias("total"), F.max("n").alias("most")).first()
    return _dealt(counts, key, whole["total"] or 0, whole["most"] or 0)


def _dealt(counts: DataFrame, key: str, total: int, most: int) -> dict[object, int]:
    if most * SHARES <= total:
        return {}
    hot = counts.where((F.col("n") * SHARES > total) & F.col(key).isNotNull()).collect()  # fewer than SHARES rows
    return {r[key]: -(-r["n"] * SHARES // total) for r in hot}


def spread_join(rows: DataFrame, few: DataFrame, key: str, how: str = "inner", hot: dict[object, int] | None = None) -> DataFrame:
    """Joins ``rows`` with ``few``, which has each key once, where one key may hold a large share of ``rows``.

    Rows of a frequent key are dealt by a hash of their columns over parts by its count, so that none has more than one in
    ``SHARES`` of the rows, and its row of ``few`` is sent to each. Where no key is so frequent, that is a plain join.
    ``hot`` says which keys are frequent; any other choice gives the same rows."""
    if hot is None:
        hot = frequent(rows.groupBy(key).agg(F.count("*").alias("n")), key)
    if not hot:
        return rows.join(few, key, how)
    known = F.create_map(*(F.lit(x) for pair in hot.items() for x in pair))
    parts = F.coalesce(F.try_element_at(known, F.col(key)), F.lit(1)).cast("int")
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(*rows.columns), parts).cast("int"))
    sent = few.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.join(sent, [key, "_part"], how).drop("_part")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with an edge; the component is its least node.

    Each round a node takes the least label around it, and then its label's label
    (pointer jumping), so the rounds grow with the logarithm of a component's width.
    Labels are aggregated before they meet, and each round is checkpointed. A node with very
    many edges, or a component with very many nodes, is dealt over several tasks; which those
    are is known from the count of edges and from the end of the round before.
    """
    both = cut(
        edges.select(F.col(a).alias("node"), F.col(b).alias("other"))
        .unionByName(edges.select(F.col(b).alias("node"), F.col(a).alias("other")))
        .distinct()
    )
    first = cut(both.groupBy("node").agg(F.min("other").alias("least"), F.count("*").alias("n")).select("node", F.least("node", "least").alias("component"), "n"))
    hubs = frequent(first.select(F.col("node").alias("other"), "n"), "other")
    labels = first.select("node", "component")
    large = frequent(labels.groupBy("component").agg(F.count("*").alias("n")), "component")
    while True:
        around = spread_join(both, labels.withColumnRenamed("node", "other"), "other", hot=hubs).groupBy("node").agg(F.min("component").alias("near"))
        step = cut(labels.join(around, "node").select("node", F.least("component", "near").alias("component"), F.col("component").alias("was")))
        # Each label once, with its own label; only then do the nodes meet it.
        used = step.select("component").distinct()
        jumps = used.join(step.select(F.col("node").alias("component"), F.col("component").alias("jump")), "component")
        jumped = spread_join(step, jumps, "component", "left", hot=large)
        jumped = cut(jumped.select("node", F.least("component", F.coalesce("jump", "component")).alias("component"), "was"))
        labels = jumped.select("node", "component")
        counts = jumped.groupBy("component").agg(F.count("*").alias("n"), F.count_if(F.col("component") != F.col("was")).alias("changed"))
        end = counts.agg(F.sum("n").alias("total"), F.max("n").alias("most"), F.sum("changed").alias("changed")).first()
        if not end["changed"]:
            return labels
        large = _dealt(counts, "component", end["total"], end["most"])
