"""Discovery over the "knows" graph within depth and budget limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.functions.urls import canonical_doc_url
from weft.operators.tables import cut

MAX_DEPTH, OUTLINKS, FRONTIER = 3, 500, 20_000
_KNOWS = "http://xmlns.com/foaf/0.1/knows"


def knows_edges(triples: DataFrame) -> DataFrame:
    """(src, dst): distinct links between canonical documents; targets without a key and links to oneself are dropped."""
    links = triples.filter((F.col("p") == _KNOWS) & F.col("o_is_iri"))
    edges = links.select(canonical_doc_url(F.col("doc_url")).alias("src"), canonical_doc_url(F.col("o")).alias("dst"))
    return edges.filter("src IS NOT NULL AND dst IS NOT NULL AND src != dst").distinct()


def first_links(triples: DataFrame) -> DataFrame:
    """(src, dst, o): the first of several links from one document to another."""
    links = triples.filter((F.col("p") == _KNOWS) & F.col("o_is_iri"))
    keyed = links.select(canonical_doc_url(F.col("doc_url")).alias("src"), canonical_doc_url(F.col("o")).alias("dst"), "o")
    return keyed.filter("dst IS NOT NULL").groupBy("src", "dst").agg(F.min("o").alias("o"))


def outlink_cap(edges: DataFrame, most: int = OUTLINKS) -> DataFrame:
    """The first ``most`` links of each document in sorted order."""
    order = Window.partitionBy("src").orderBy("dst")
    return edges.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= most).drop("__n")


def new_links(edges: DataFrame, known: DataFrame) -> DataFrame:
    """Link targets that are not known (doc_url) yet."""
    return edges.select(F.col("dst").alias("doc_url")).distinct().join(known.select("doc_url"), "doc_url", "left_anti")


def fanout(edges: DataFrame, most: int = OUTLINKS) -> DataFrame:
    """(src, n, over): out-degree of each document against the cap."""
    return edges.groupBy("src").agg(F.count("*").alias("n")).withColumn("over", F.col("n") > most)


def expand(seeds: DataFrame, edges: DataFrame, depth: int = MAX_DEPTH, gate: DataFrame | None = None) -> DataFrame:
    """(doc_url, depth): breadth-first discovery from ``seeds`` (doc_url), each document once at its smallest depth.

    ``gate`` (doc_url) is never entered. A round for each depth; each is cut from its lineage, and so are the edges, which all rounds read.
    """
    edges = edges if gate is None else edges.join(gate.select(F.col("doc_url").alias("dst")).distinct(), "dst", "left_anti")
    edges = cut(edges.select("src", "dst"))
    start = seeds.select("doc_url").distinct()
    start = start.join(gate, "doc_url", "left_anti") if gate is not None else start
    visited = cut(start.withColumn("depth", F.lit(0)))
    layer = visited
    for level in range(1, depth + 1):
        found = layer.join(edges, layer["doc_url"] == edges["src"]).select(F.col("dst").alias("doc_url")).distinct()
        found = found.join(visited.select("doc_url"), "doc_url", "left_anti")
        layer = cut(found.withColumn("depth", F.lit(level)))
        visited = visited.union(layer)
    return visited


def subtree_budget(found: DataFrame, budgets: DataFrame) -> DataFrame:
    """Those of ``found`` (root_seed, depth, discovered_from, doc_url) that their root's remaining budget admits; no root, none.

    ``budgets`` is (root_seed, remaining). A budget is small, so each root keeps few rows after a first cut by salt.
    """
    order = ["depth", "discovered_from", "doc_url"]
    rows = found.join(budgets, "root_seed")
    salted = Window.partitionBy("root_seed", F.pmod(F.xxhash64("doc_url"), F.lit(32))).orderBy(*order)
    few = rows.withColumn("__n", F.row_number().over(salted)).filter("__n <= remaining")
    own = Window.partitionBy("root_seed").orderBy(*order)
    return few.withColumn("__n", F.row_number().over(own)).filter("__n <= remaining").drop("__n", "remaining")


def expand_budgeted(seeds: DataFrame, edges: DataFrame, budget: int, depth: int = MAX_DEPTH, outlinks: int = OUTLINKS) -> DataFrame:
    """(doc_url, root_seed, discovered_from, depth): discovery with an outlink cap and a budget that each seed's whole subtree shares.

    A document found from several sides in one round belongs to the smallest root and then the smallest source.
    """
    capped = cut(outlink_cap(edges, outlinks))
    visited = cut(
        seeds.select("doc_url", F.col("doc_url").alias("root_seed"), F.lit(None).cast("string").alias("discovered_from"), F.lit(0).alias("depth"))
    )
    budgets = visited.select("root_seed", F.lit(budget).alias("remaining"))
    layer = visited
    for level in range(1, depth + 1):
        links = layer.join(capped, layer["doc_url"] == capped["src"]).select(
            F.col("dst").alias("doc_url"), "root_seed", F.col("src").alias("discovered_from")
        )
        first = links.groupBy("doc_url").agg(F.min(F.struct("root_seed", "discovered_from")).alias("f"))
        fresh = first.select("doc_url", "f.root_seed", "f.discovered_from", F.lit(level).alias("depth"))
        fresh = fresh.join(visited.select("doc_url"), "doc_url", "left_anti")
        layer = cut(subtree_budget(fresh, budgets).select("doc_url", "root_seed", "discovered_from", "depth"))
        visited = visited.union(layer)
        spent = layer.groupBy("root_seed").agg(F.count("*").alias("spent"))
        budgets = cut(
            budgets.join(spent, "root_seed", "left").select("root_seed", (F.col("remaining") - F.coalesce("spent", F.lit(0))).alias("remaining"))
        )
    return visited


def frontier_cap(new: DataFrame, live: int, most: int = FRONTIER) -> DataFrame:
    """The first of ``new`` (doc_url) that fit under ``most`` live documents."""
    return new.orderBy("doc_url").limit(max(0, most - live))
