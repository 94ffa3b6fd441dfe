"""Coverage of a taxonomy by rows, and coverage-aware trimming."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import materialise
from .taxonomy import find_by_name, level_totals


def coverage(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(factor, level, covered, total, ratio, nodes) from the rows' paths (factor, path).

    Every beginning of a path counts, at its position. Paths that are not in
    the tree count as covered, so a ratio may exceed 1; factors and levels that
    the tree lacks are left out. Paths are made distinct before they are
    exploded, so a popular leaf is exploded once.
    """
    seen = paths.select("factor", "path").distinct().select("factor", F.explode(T.prefixes(F.col("path"))).alias("p"))
    got = seen.select("factor", (F.size("p") - 1).alias("level"), F.array_join("p", "/").alias("node")).distinct()
    got = got.groupBy("factor", "level").agg(F.count("*").alias("covered"), F.sort_array(F.collect_list("node")).alias("nodes"))
    out = level_totals(nodes).join(got, ["factor", "level"], "left")
    covered = F.coalesce("covered", F.lit(0).cast("long"))
    return out.select("factor", "level", covered.alias("covered"), "total", F.round(covered / F.col("total"), 6).alias("ratio"), F.coalesce("nodes", F.array().cast("array<string>")).alias("nodes"))


def lineage_paths(rows: DataFrame, mix_col: str = "taxonomy_mix") -> DataFrame:
    """(factor, path) of the rows' mixes; an entry without path stands for its node."""
    return rows.select(F.explode(mix_col).alias("m")).select("m.factor", F.coalesce("m.path", F.array("m.node")).alias("path"))


def reassigned_coverage(assigned: DataFrame, nodes: DataFrame) -> DataFrame:
    """Coverage by judged assignments (factor, wanted): names that no node has are left out."""
    return coverage(find_by_name(nodes, assigned), nodes)


#: Distinct path sets that the driver takes in, at most.
DRIVER_SETS = 1 << 16


def _lazy_greedy(sets: list[tuple[int, list[str]]], target: int) -> list[int]:
    """Rows in order of choice: a gain only ever falls, so the top of the heap is best once its gain is up to date."""
    left = {o: set(paths) for o, paths in sets}
    heap = [(-len(paths), o) for o, paths in left.items()]
    heapq.heapify(heap)
    used: set[str] = set()
    chosen: list[int] = []
    while heap and len(chosen) < target:
        gain, o = heapq.heappop(heap)
        left[o] -= used
        if len(left[o]) < -gain:
            heapq.heappush(heap, (-len(left[o]), o))
        elif gain:
            chosen.append(o)
            used |= left[o]
        else:
            break
    return chosen


def _greedy_rounds(sets: DataFrame, target: int) -> list[int]:
    """The same, a pass over the path sets for each choice."""
    chosen: list[int] = []
    best = sets.select("ord", "paths", F.size("paths").alias("gain"))
    while len(chosen) < target:
        got = best.filter("gain > 0").orderBy(F.desc("gain"), "ord").limit(1).collect()
        if not got:
            break
        chosen.append(got[0]["ord"])
        rest = best.select("ord", F.array_except("paths", F.array(*[F.lit(p) for p in got[0]["paths"]])).alias("paths")).withColumn("gain", F.size("paths"))
        best = materialise(rest.filter("gain > 0"))
    return chosen


def trim(spark: SparkSession, rows: DataFrame, target: int, ord_col: str = "ord", paths_col: str = "paths") -> DataFrame:
    """(ord, rank): rows chosen greedily for most unseen paths, ties to the earliest, at most ``target``.

    Only the first row of each distinct path set can have a gain, and there are
    few path sets: up to DRIVER_SETS the driver takes them lazily from a heap,
    more are searched in distributed rounds. All other rows follow in order.
    """
    sets = materialise(rows.groupBy(F.array_sort(F.array_distinct(paths_col)).alias("paths")).agg(F.min(ord_col).alias("ord")))
    if sets.count() <= DRIVER_SETS:
        chosen = _lazy_greedy([(r["ord"], r["paths"]) for r in sets.collect()], target)
    else:
        chosen = _greedy_rounds(sets, target)
    first = spark.createDataFrame([(o, k) for k, o in enumerate(chosen)], "ord long, rank long")
    rest = rows.select(F.col(ord_col).cast("long").alias("ord")).join(first.select("ord"), "ord", "left_anti").orderBy("ord").limit(max(0, target - len(chosen)))
    numbered = rest.withColumn("rank", F.row_number().over(Window.orderBy("ord")) - 1 + len(chosen))
    return first.unionByName(numbered.select("ord", F.col("rank").cast("long").alias("rank")))
