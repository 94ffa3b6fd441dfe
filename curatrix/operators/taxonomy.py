"""Taxonomies as path tables.

A node is a row (factor, ord, name, description, level, path, path_str,
path_key, weight, is_leaf); ``ord`` numbers a factor's nodes in preorder.
Recursion over a tree becomes comparison of paths.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

NODE_DDL = "factor string, ord int, name string, description string, level int, path array<string>, weight double"


def walk(tree: dict[str, Any]):
    """Rows of a nested taxonomy in preorder; roots without path or weight have [name] and 1."""
    for factor in tree.get("factors", []):
        order, stack = 0, [factor]
        while stack:
            node = stack.pop()
            try:
                weight = max(0.0, float(node.get("weight", 1.0)))
            except (TypeError, ValueError):
                weight = 1.0
            yield factor["name"], order, node["name"], node.get("description", ""), int(node.get("level", 0)), list(node.get("path") or [node["name"]]), weight
            order += 1
            stack.extend(reversed(node.get("children") or []))


def from_tree(spark: SparkSession, tree: dict[str, Any]) -> DataFrame:
    return complete(spark.createDataFrame(list(walk(tree)), NODE_DDL))


def to_tree(nodes: DataFrame, description: str = "") -> dict[str, Any]:
    """The nested form of a (small) node table."""
    by_path: dict[tuple, dict] = {}
    factors = []
    for r in nodes.orderBy("factor", "ord").collect():
        node = {"name": r["name"], "description": r["description"], "level": r["level"], "path": list(r["path"]), "weight": r["weight"], "children": []}
        by_path[r["factor"], tuple(r["path"])] = node
        parent = by_path.get((r["factor"], tuple(r["path"][:-1])))
        (parent["children"] if parent else factors).append(node)
    return {"description": description, "factors": factors}


def complete(nodes: DataFrame) -> DataFrame:
    """Add path_str, path_key, parent path and is_leaf."""
    out = nodes.withColumn("path_str", F.array_join("path", "/")).withColumn("path_key", T.path_key(F.col("path")))
    parents = nodes.filter(F.size("path") > 1).select(F.col("factor").alias("pf"), F.slice("path", F.lit(1), F.size("path") - 1).alias("pp")).distinct()
    return out.join(parents, (F.col("factor") == F.col("pf")) & (F.col("path") == F.col("pp")), "left").withColumn("is_leaf", F.col("pp").isNull()).drop("pf", "pp")


def level_totals(nodes: DataFrame) -> DataFrame:
    """Distinct paths of each factor and level."""
    return nodes.groupBy("factor", "level").agg(F.countDistinct("path_str").alias("total"))


def statistics(nodes: DataFrame) -> DataFrame:
    """Nodes, leaves, depth, parents and mean branching of each factor."""
    out = nodes.groupBy("factor").agg(F.count("*").alias("nodes"), F.count_if("is_leaf").alias("leaves"), F.max("level").alias("depth"), F.count_if(~F.col("is_leaf")).alias("parents"))
    return out.withColumn("branching", F.round(F.when(F.col("parents") > 0, (F.col("nodes") - 1) / F.col("parents")).otherwise(0.0), 6))


def outline(nodes: DataFrame) -> DataFrame:
    """(factor, outline): the indented listing of each tree."""
    line = F.concat(F.repeat(F.lit("  "), F.col("level")), F.lit("- "), F.col("name"), F.lit(": "), F.col("description"))
    lines = nodes.groupBy("factor").agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("l"))
    return lines.select("factor", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("outline"))


def flattened(nodes: DataFrame) -> DataFrame:
    """(factor, id, parent, depth), ids being path strings; a root's parent is null."""
    parent = F.when(F.size("path") > 1, F.array_join(F.slice("path", F.lit(1), F.size("path") - 1), "/"))
    return nodes.select("factor", F.col("path_str").alias("id"), parent.alias("parent"), (F.size("path") - 1).alias("depth"))


def searchable(nodes: DataFrame) -> DataFrame:
    """(factor, path_str, text): lower-case text of each node with all its descendants'.

    Every node gives its text to each beginning of its path: an equi-join on
    (factor, path) by explode, not a comparison of all nodes with all.
    """
    own = F.lower(F.concat_ws(" ", "name", "description", "path_str"))
    up = nodes.select("factor", F.col("ord"), own.alias("own"), F.explode(T.prefixes(F.col("path"))).alias("path"))
    return up.groupBy("factor", F.array_join("path", "/").alias("path_str")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "own"))), lambda x: x["own"]), " ").alias("text"))


def search(nodes: DataFrame, needle: str) -> DataFrame:
    """Nodes whose own or any descendant's text contains the needle, in any case."""
    return searchable(nodes).filter(F.contains("text", F.lit(needle.strip().lower()))).select("factor", "path_str")


def find_by_name(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """(factor, wanted, path): the first node in preorder of that name, case-folded, within the factor. ``names`` has (factor, wanted)."""
    wanted = names.select("factor", "wanted").distinct().withColumn("k", T.casefold(F.col("wanted")))
    hits = nodes.select("factor", "ord", "path", T.casefold(F.col("name")).alias("k")).join(wanted, ["factor", "k"])
    return hits.groupBy("factor", "wanted").agg(F.min_by("path", "ord").alias("path"))


def strategies_or_general(strategies: DataFrame, nodes: DataFrame) -> DataFrame:
    """The strategies, or one 'general' strategy over all factors where there is none."""
    factors = nodes.filter("level = 0").agg(F.sort_array(F.collect_set("factor")).alias("roots"))
    general = factors.select(F.lit("general").alias("id"), F.lit("All factors").alias("description"), "roots", F.lit(1.0).alias("weight"), F.array().cast("array<array<string>>").alias("never_combine"))
    return strategies.unionByName(general.join(strategies.limit(1).select(F.lit(1).alias("one")), how="left").filter("one is null").drop("one"))


def invalid_paths(strategies: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, pos, ref): roots and never_combine paths that name no node; repeats and order are kept."""
    refs = F.concat("roots", F.flatten(F.filter("never_combine", lambda p: F.size(p) == 2)))
    each = strategies.select("id", F.posexplode(refs).alias("pos", "ref")).withColumn("k", T.root_key(F.col("ref")))
    known = nodes.select(F.col("path_key").alias("k")).distinct()
    return each.join(F.broadcast(known) if nodes.count() <= 100_000 else known, "k", "left_anti").select("id", "pos", "ref")


def uncovered_factors(strategies: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, factor): factors that none of a strategy's roots lies in."""
    covered = strategies.select("id", F.explode("roots").alias("root")).select("id", T.root_key(F.col("root"))[0].alias("k"))
    factors = nodes.filter("level = 0").select("factor", F.col("path_key")[0].alias("k")).distinct()
    return strategies.select("id").crossJoin(factors).join(covered, ["id", "k"], "left_anti").select("id", "factor")


def parse_taxonomy(text: str) -> dict[str, Any]:
    """A taxonomy from JSON in any of the accepted shapes: {factors}, a list of nodes, or one node."""
    data = json.loads(text)
    if isinstance(data, list):
        return {"description": "", "factors": data}
    if "factors" in data:
        return data
    if "name" in data:
        return {"description": data.get("description", ""), "factors": [data]}
    raise ValueError("not a taxonomy")


def preorder(nodes: DataFrame) -> DataFrame:
    """Number nodes in preorder, siblings by name."""
    return nodes.withColumn("ord", (F.row_number().over(Window.partitionBy("factor").orderBy("path")) - 1).cast("int"))
