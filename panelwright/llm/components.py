"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelwright.llm.common import in_few, stored


def _named(links: DataFrame, roots: DataFrame) -> DataFrame:
    """The links between different components, as links of their roots."""
    for side in "ab":
        ends = roots.select(F.col("rec").alias("_r"), F.col("root").alias("_end"))
        links = links.join(ends, F.col(side) == F.col("_r"), "left").withColumn(
            side, F.coalesce("_end", side)).drop("_r", "_end")
    return links


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Rows (rec, root) for every record of ``links`` (a, b); root is the least record reachable.

    A round points every record at the least of itself and its neighbours, follows those pointers
    to their ends by doubling, and keeps the links between different ends only. A hub's neighbours
    are reduced before the shuffle. The number of rounds is about the logarithm of the longest path.

    ``known`` are the components (rec, root) of earlier links, to which ``links`` are added; only those
    between different ones are followed.
    """
    rows = links.count() + (known.count() if known is not None else 0)

    def kept(df: DataFrame, label: str) -> DataFrame:
        return stored(in_few(df, 2 * rows), label)

    added = known is not None
    new = _named(links.select("a", "b"), known) if added else links
    edges = kept(new.filter("a != b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while edges.head(1):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = kept(both.groupBy(F.col("a").alias("rec")).agg(
            F.least(F.min("b"), F.first("a")).alias("root")), "pointers")
        while True:
            step = up.select(F.col("rec").alias("_r"), F.col("root").alias("_end"))
            doubled = up.join(step, F.col("root") == F.col("_r")).select(
                "rec", F.col("_end").alias("root"), (F.col("_end") != F.col("root")).alias("moved"))
            doubled = kept(doubled, "pointers")
            up = doubled.drop("moved")
            if not doubled.filter("moved").head(1):
                break
        if known is None:
            known = up
        else:
            # records that no earlier link had come in with the first round
            ends = up.select(F.col("rec").alias("_r"), F.col("root").alias("_end"))
            known = kept(known.join(ends, F.col("root") == F.col("_r"), "full" if added else "left").select(
                F.coalesce("rec", "_r").alias("rec"), F.coalesce("_end", "root").alias("root")), "roots")
            added = False
        edges = kept(_named(edges, up).filter("a != b").select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    if known is None:
        return edges.select(F.col("a").alias("rec"), F.col("b").alias("root"))
    return known
