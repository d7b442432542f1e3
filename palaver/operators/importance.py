"""Importance of top-level messages, and of people by who replies to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.session import shared_folder


def score(messages: DataFrame, replies: DataFrame) -> DataFrame:
    """``importance = reactions + 2 * replies + people replying``, all counts."""
    activity = replies.groupBy("channel", F.col("parent_ts").alias("timestamp")).agg(
        F.count(F.lit(1)).alias("n_replies"), F.count_distinct("user").alias("n_people")
    )
    reacted = F.aggregate("reactions", F.lit(0).cast("bigint"), lambda acc, r: acc + r["count"])
    joined = messages.join(activity, ["channel", "timestamp"], "left")
    n_replies, n_people = F.coalesce("n_replies", F.lit(0)), F.coalesce("n_people", F.lit(0))
    return joined.select(
        "channel",
        "timestamp",
        reacted.alias("n_reactions"),
        n_replies.alias("n_replies"),
        n_people.alias("n_people"),
        (reacted + 2 * n_replies + n_people).alias("importance"),
    )


def reply_links(messages: DataFrame, replies: DataFrame) -> DataFrame:
    """``source, target, weight``: who replied to whom, and how often."""
    parents = messages.select("channel", F.col("timestamp").alias("parent_ts"), F.col("user").alias("target"))
    pairs = replies.select("channel", "parent_ts", F.col("user").alias("source")).join(parents, ["channel", "parent_ts"])
    return pairs.groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight"))


def rank(links: DataFrame, damping: float = 0.85, tolerance: float = 1e-9, rounds: int = 100) -> DataFrame:
    """``node, rank``: standing of everyone in a weighted graph, by power iteration; ranks add up to 1.

    A node hands ``damping`` of its rank to those it links to, in proportion to the weights, the rest
    evenly to all; a node without links hands everything evenly to all. Loops count as links. The iteration ends
    when the ranks change by no more than ``tolerance`` in sum, or after ``rounds``. Each round is
    a table in the shared folder, so lineage stays short; only sums come to the driver. Sums by target are begun before
    the exchange, and the adaptive join splits a node with very many links.
    """
    spark, folder = links.sparkSession, shared_folder(links.sparkSession, "rank")
    heavy = links.filter("source IS NOT NULL AND target IS NOT NULL AND weight > 0").groupBy("source", "target").agg(F.sum("weight").alias("weight"))
    heavy.write.parquet(f"{folder}/links")
    heavy = spark.read.parquet(f"{folder}/links")
    out = heavy.groupBy("source").agg(F.sum("weight").alias("out"))
    heavy.join(out, "source").select("source", "target", (F.col("weight") / F.col("out")).alias("share")).write.parquet(f"{folder}/shares")
    shares = spark.read.parquet(f"{folder}/shares")
    nodes = heavy.select(F.col("source").alias("node")).union(heavy.select("target")).distinct()
    nodes.join(out.select(F.col("source").alias("node"), F.lit(True).alias("links")), "node", "left").write.parquet(f"{folder}/nodes")
    nodes = spark.read.parquet(f"{folder}/nodes")
    n = nodes.count()
    nodes.withColumn("rank", F.lit(1.0 / max(n, 1))).write.parquet(f"{folder}/round=0")
    ranks = spark.read.parquet(f"{folder}/round=0")
    for i in range(1, rounds + 1 if n else 0):
        loose = ranks.filter("links IS NULL").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        got = shares.join(ranks, shares["source"] == ranks["node"]).groupBy("target").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        even = (1 - damping + damping * loose) / n
        moved = ranks.join(got, F.col("node") == F.col("target"), "left").select(
            "node", "links", F.col("rank").alias("before"), (F.lit(even) + damping * F.coalesce("got", F.lit(0.0))).alias("rank")
        )
        moved.write.parquet(f"{folder}/round={i}")
        stored = spark.read.parquet(f"{folder}/round={i}")
        ranks = stored.drop("before")
        if stored.agg(F.sum(F.abs(F.col("rank") - F.col("before")))).first()[0] <= tolerance:
            break
    return ranks.select("node", "rank")
