"""Search of nodes by parts of their id or label, over postings of runs of one to three characters.

The index is made once and kept as Parquet; a search reads the postings of its pattern's runs alone, counts how many of them each
node has, and confirms the pattern in the names of those that have all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONGEST = 3


def grams(text: Column) -> Column:
    """Distinct runs of 1 to 3 characters of a text in lower case."""

    def runs(low: Column) -> Column:
        def of_length(k: int) -> Column:
            return F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - (k - 1), F.lit(1))), lambda i: F.substr(low, i, F.lit(k)))

        return F.array_distinct(F.filter(F.concat(*map(of_length, range(1, LONGEST + 1))), lambda g: g != ""))

    return F.get(F.transform(F.array(F.lower(text)), runs), F.lit(0))


def postings(nodes: DataFrame) -> DataFrame:
    """gram, id: each run of characters and the nodes whose id or label holds it. Null labels hold nothing."""
    both = F.array_union(grams(F.col("id")), F.coalesce(grams(F.col("label")), F.array().cast("array<string>")))
    return nodes.where("id is not null").select(F.explode(both).alias("gram"), "id")


def write_index(nodes: DataFrame, path: str) -> None:
    """The index of nodes (id, label) under a folder: postings in order of their runs, and the names that confirm hits."""
    postings(nodes).repartitionByRange("gram", "id").sortWithinPartitions("gram", "id").write.mode("overwrite").parquet(f"{path}/postings")
    nodes.where("id is not null").select("id", "label").write.mode("overwrite").parquet(f"{path}/names")


def pattern_grams(text: str) -> list[str]:
    low = text.lower()
    return list(dict.fromkeys(low[i : i + LONGEST] for i in range(max(1, len(low) - LONGEST + 1)))) if low else []


def hits(index: DataFrame, names: DataFrame, text: str) -> DataFrame:
    """Ids of nodes whose id or label holds text in any case; an empty text is held by all.

    index has gram and id, names id and label. The pattern's runs are literals, so they reach the scan of the postings as a filter.
    """
    own = pattern_grams(text)
    if not own:
        return names.select("id")
    able = index.where(F.col("gram").isin(own)).groupBy("id").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(own))
    needle = F.lit(text.lower())
    return names.join(able.select("id"), "id", "left_semi").where(F.lower("id").contains(needle) | F.coalesce(F.lower("label").contains(needle), F.lit(False))).select("id")
