"""Project trees as edge tables (node_id, parent_id), of any depth and size.

Where every node has one parent, each node looks up its ancestors in jumps that double: after k rounds it knows the one 2 ** k above it, so a chain of a million nodes takes 20 rounds. Nodes that haven't met the root
after as many rounds as the number of nodes needs are on a cycle, or below one, and aren't in the tree. Where a node has several parents, levels are taken one by one from the root, without nodes that were
met before, and a node counts at its smallest depth; that takes as many rounds as there are levels.
"""

from __future__ import annotations

import json
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citemill.session import stored


def closure(edges: DataFrame, root) -> DataFrame:
    """(node_id, depth) of the root and all below it, each once. Empty if no row has the root as its node; edges of a node to itself and rows without a node don't count."""
    kind = edges.schema["node_id"].dataType
    own = edges.select("node_id", F.col("parent_id").cast(kind).alias("parent_id")).where("node_id IS NOT NULL")
    top = F.lit(root).cast(kind)
    start = own.where(F.col("node_id") == top).select("node_id", F.lit(0).alias("depth")).distinct()
    links = stored(own.where((F.col("node_id") != top) & F.col("parent_id").isNotNull() & (F.col("node_id") != F.col("parent_id"))).distinct())
    several = links.groupBy("node_id").agg(F.count("*").alias("n")).where("n > 1")
    return start if start.isEmpty() else _by_level(links, start) if not several.isEmpty() else _by_jumps(links, start, top)


def _by_jumps(links: DataFrame, start: DataFrame, top) -> DataFrame:
    """With one parent a node."""
    todo = stored(links.select("node_id", F.col("parent_id").alias("up"), F.lit(1).alias("dist")))
    done = [start]
    for _ in range(todo.count().bit_length() + 1):
        done.append(todo.where(F.col("up") == top).select("node_id", F.col("dist").alias("depth")))
        todo = todo.where(F.col("up") != top)
        met = reduce(DataFrame.union, done[1:]).select("node_id", top, "depth")
        above = todo.union(met).toDF("_n", "_up", "_dist")
        todo = stored(todo.join(above, F.col("up") == F.col("_n")).select("node_id", F.col("_up").alias("up"), (F.col("dist") + F.col("_dist")).alias("dist")))
        if todo.isEmpty():
            break
    return reduce(DataFrame.union, done)


def _by_level(links: DataFrame, start: DataFrame) -> DataFrame:
    """With several parents a node, in rounds from the root."""
    seen = level = stored(start)
    depth, done = 0, [level]
    while True:
        depth += 1
        found = links.join(level.select(F.col("node_id").alias("_up")), F.col("parent_id") == F.col("_up")).select("node_id").distinct()
        level = stored(found.join(seen, "node_id", "left_anti").withColumn("depth", F.lit(depth)))
        if level.isEmpty():
            return reduce(DataFrame.union, done)
        done.append(level)
        seen = seen.union(level) if depth % 16 else stored(seen.union(level))


def descendants(edges: DataFrame, root) -> DataFrame:
    return closure(edges, root).where("depth > 0")


def depths(edges: DataFrame, root) -> DataFrame:
    """(depth, nodes): how many nodes each level has."""
    return closure(edges, root).groupBy("depth").agg(F.count("*").alias("nodes"))


def node_count(edges: DataFrame, root) -> DataFrame:
    return closure(edges, root).agg(F.count("*").alias("nodes"))


def node_files(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Files of the nodes of a tree; folders aren't files."""
    return files.where("kind = 'file'").join(nodes.select("node_id"), "node_id")


def documents(nodes: DataFrame, edges: DataFrame, root, files: DataFrame | None = None) -> DataFrame:
    """(root, document): the tree as one JSON document, which is written to project_tree.json. Nodes nest in children, ordered by id; each node of the tree has id, type and attributes from nodes
    (node_id, type, attributes as JSON) and files from files (node_id, file as JSON, order). A node with several parents stands below its first one by id.

    A document is one value, so one task puts it together; its nodes are found by joins.
    """
    found = closure(edges, root)
    kind = edges.schema["node_id"].dataType
    up = edges.select(F.col("node_id"), F.col("parent_id").cast(kind).alias("parent_id")).where("node_id <> parent_id")
    above = up.join(found.select(F.col("node_id").alias("parent_id"), (F.col("depth") + 1).alias("depth")), "parent_id").join(found, ["node_id", "depth"]).groupBy("node_id").agg(F.min("parent_id").alias("parent_id"))
    rows = found.join(above, "node_id", "left").join(nodes.select("node_id", "type", "attributes"), "node_id", "left")
    if files is not None:
        rows = rows.join(files.groupBy("node_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("order", "file"))), lambda f: f["file"]).alias("files")), "node_id", "left")
    else:
        rows = rows.withColumn("files", F.array().cast("array<string>"))
    rows = rows.select(F.lit(root).cast(kind).cast("string").alias("root"), F.col("node_id").cast("string").alias("node"), F.col("parent_id").cast("string").alias("parent"), "depth", "type", "attributes", "files")
    return rows.groupBy("root").applyInArrow(_document, "root string, document string")


def _document(part: pa.Table) -> pa.Table:
    children: dict[str, list[str]] = {}
    written = "{}"
    for r in sorted(part.to_pylist(), key=lambda r: (-r["depth"], r["node"])):  # from the leaves up; no recursion, as trees may be deep
        written = f'{{"id": {json.dumps(r["node"])}, "type": {json.dumps(r["type"])}, "attributes": {r["attributes"] or "{}"}, "children": [{", ".join(children.pop(r["node"], []))}], "files": [{", ".join(r["files"] or [])}]}}'
        children.setdefault(r["parent"], []).append(written)
    return pa.table({"root": part.column("root")[:1], "document": [written]})
