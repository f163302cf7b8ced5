"""Edges between elements: closures, inherited methods, bridges, affordances, alias groups."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .matching import shuffled

#: Ids in an array of facade_edges, backends of such an array that are opened at once, and backends for each of its tasks.
EDGE_BLOCK, EDGE_SLICE, BACKENDS_PER_TASK = 2048, 8, 4096


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage of an iteration: a checkpoint in the cluster's shared folder, which survives lost executors.

    Without spark.checkpoint.dir, a temporary folder is taken, on a single machine only.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="coverloom-"))
    return df.checkpoint()


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst, depth) of all paths along edges (src, dst); cycles end, and no node reaches itself."""
    step = cut(edges.select("src", "dst").where("src <> dst").distinct())
    seen, frontier, depth = step.withColumn("depth", F.lit(1)), step, 1
    while True:
        depth += 1
        nxt = frontier.join(step.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst").select("src", F.col("far").alias("dst")).where("src <> dst").distinct()
        frontier = cut(nxt.join(seen, ["src", "dst"], "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = cut(seen.unionByName(frontier.withColumn("depth", F.lit(depth))))


def inherited_methods(methods: DataFrame, composed: DataFrame) -> DataFrame:
    """(id, parent_id): methods that a protocol gets through composition and doesn't have itself.

    methods has (protocol, method); composed is a closure (src, dst, depth). The nearest parent wins,
    then the first by name.
    """
    reached = composed.join(methods.select(F.col("protocol").alias("dst"), "method"), "dst")
    rank = F.row_number().over(W.partitionBy("src", "method").orderBy("depth", "dst"))
    first = reached.withColumn("_rank", rank).where("_rank = 1")
    own = methods.select(F.col("protocol").alias("src"), "method")
    return first.join(own, ["src", "method"], "left_anti").select(F.concat_ws(".", "src", "method").alias("id"), F.concat_ws(".", "dst", "method").alias("parent_id"))


def implementors(elements: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = ("METHOD", "TYPE", "PROTOCOL", "SYSCALL")) -> DataFrame:
    """(element_id, implementors): for interface kinds, the ids of what implements them, sorted."""
    owners = edges.where("kind = 'IMPLEMENTS'").groupBy(F.col("target_id").alias("element_id")).agg(F.array_sort(F.collect_set("src_id")).alias("implementors"))
    return elements.where(F.col("kind").isin(*kinds)).select(F.col("id").alias("element_id")).join(owners, "element_id", "left").withColumn("implementors", F.coalesce("implementors", F.array().cast("array<string>")))


def bridge_evidence(rows: DataFrame, same_as: DataFrame) -> DataFrame:
    """Evidence united over SAME_AS pairs (a, b), both ways and one hop; multiplicity is kept.

    Reference pages of dockerdoc stay with their own element.
    """
    pairs = same_as.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).where("x <> y").distinct()
    both = pairs.select(F.col("x").alias("element_id"), F.col("y").alias("to")).unionByName(pairs.select(F.col("y").alias("element_id"), F.col("x").alias("to")))
    given = rows.where(F.coalesce(F.col("bucket"), F.lit("")) != "reference.dockerdoc") if "bucket" in rows.columns else rows
    shared = given.join(both, "element_id").drop("element_id").withColumnRenamed("to", "element_id")
    return rows.unionByName(shared.select(rows.columns))


def template_bridge(source: DataFrame, target: DataFrame, rendered: Column) -> DataFrame:
    """SAME_AS pairs from an id template; missing targets and self edges go."""
    return source.select(F.col("id").alias("a"), rendered.alias("b")).join(target.select(F.col("id").alias("b")).distinct(), "b", "left_semi").where("a <> b").select("a", "b").distinct()


def affordances(elements: DataFrame, low: int = 2, high: int = 8) -> DataFrame:
    """(a, b, score) of elements alike in kind and normalized name, in clusters of `low` to `high`.

    The score starts at 0.70 and adds 0.15 for one type and 0.05 each for one max_size, max_count and
    default_value, where they aren't empty; 0.95 at most. Clusters are counted before their rows are joined,
    so a popular name isn't gathered anywhere.
    """
    columns = ("type", "max_size", "max_count", "default_value")
    named = elements.select("id", "kind", *columns, T.affordance_name(F.col("id")).alias("_name")).where("_name <> ''")
    sized = named.groupBy("kind", "_name").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n").between(low, high)).drop("_n")
    kept = named.join(sized, ["kind", "_name"])
    x = kept.select("kind", "_name", *(F.col(c).alias(f"x_{c}") for c in ("id", *columns)))
    y = kept.select("kind", "_name", *(F.col(c).alias(f"y_{c}") for c in ("id", *columns)))
    same = lambda c, v: F.when((F.col(f"x_{c}") == F.col(f"y_{c}")) & (F.col(f"x_{c}") != ""), v).otherwise(0.0)
    score = F.lit(0.70) + same("type", 0.15) + same("max_size", 0.05) + same("max_count", 0.05) + same("default_value", 0.05)
    pairs = x.join(y, ["kind", "_name"]).where("x_id <> y_id")
    return pairs.select(F.col("x_id").alias("a"), F.col("y_id").alias("b"), F.round(F.least(score, F.lit(0.95)), 2).alias("score"))


def _blocks(rows: DataFrame, n: int, name: str) -> DataFrame:
    """(library, local, name): the ids of each library and local name in arrays of EDGE_BLOCK at most. n: the number of rows.

    Rows of a key are numbered by parts of about EDGE_BLOCK * 128 rows, so a frequent key isn't one task.
    """
    own = rows.where("library is not null and local is not null and id is not null")
    part = F.pmod(F.xxhash64("id"), F.lit(-(-n // (EDGE_BLOCK * 128)) or 1))
    place = F.row_number().over(W.partitionBy("library", "local", "part").orderBy("id"))
    own = own.select("library", "local", "id", part.alias("part")).withColumn("block", F.floor((place - 1) / EDGE_BLOCK))
    return own.groupBy("library", "local", "part", "block").agg(F.collect_list("id").alias(name)).select("library", "local", name)


def facade_edges(backends: DataFrame, path_map: DataFrame, module_map: DataFrame, facades: DataFrame) -> DataFrame:
    """Backend element to facade element of the same local name: the path decides, else the module.

    Edges grow with the square of a name's elements, so arrays of ids are joined and dealt evenly over tasks, and
    each task writes out the pairs of its arrays. Spark compiles nested explodes into one loop, which holds a copy of all
    rows that it makes of an input row. An operator with a lambda is never compiled, so the slices that it cuts
    arrive one by one, and EDGE_SLICE * EDGE_BLOCK pairs are held at most.
    """
    out = backends.join(path_map.select("path", F.col("facade").alias("by_path")), "path", "left").join(module_map.select("module", F.col("facade").alias("by_module")), "module", "left")
    out = out.withColumn("library", F.coalesce("by_path", "by_module"))
    n = backends.count()
    met = _blocks(out, n, "sources").join(shuffled(_blocks(facades, facades.count(), "targets")), ["library", "local"])
    dealt = met.select("sources", "targets").repartition(-(-n // BACKENDS_PER_TASK) or 1)
    starts = F.sequence(F.lit(1), F.size("sources"), F.lit(EDGE_SLICE))
    few = dealt.select(F.explode(F.transform(starts, lambda i: F.slice("sources", i, EDGE_SLICE))).alias("few"), "targets")
    pairs = few.select(F.explode("few").alias("src_id"), "targets").select("src_id", F.explode("targets").alias("facade_id"))
    return pairs.where("src_id <> facade_id")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component; labels spread until none changes."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = cut(nodes.select("node", F.col("node").alias("root")))
    while True:
        near = both.join(labels.select(F.col("node").alias("a"), "root"), "a").groupBy(F.col("b").alias("node")).agg(F.min("root").alias("near"))
        stepped = labels.join(near, "node", "left").select("node", F.least("root", F.coalesce("near", "root")).alias("next"), "root")
        # a label also takes its root's own label, so long paths shorten
        jump = stepped.select(F.col("node").alias("next"), F.col("next").alias("further"))
        moved = cut(stepped.join(jump, "next", "left").select("node", F.least("next", F.coalesce("further", "next")).alias("root"), F.col("root").alias("old")))
        if moved.where("root <> old").isEmpty():
            return moved.select("node", "root")
        labels = moved.select("node", "root")


def alias_groups(commands: DataFrame) -> DataFrame:
    """(root, id, aliases): of commands that are aliases of each other, the one of most words, then the first, stays."""
    known = commands.select(F.col("id").alias("b"))
    links = commands.select(F.col("id").alias("a"), F.explode("aliases").alias("b")).join(known, "b", "left_semi").select("a", "b")
    groups = components(commands.select(F.col("id").alias("node")), links)
    own = commands.join(groups, F.col("id") == F.col("node"))
    depth = F.size(F.split("id", " "))
    kept = own.groupBy("root").agg(F.min_by("id", F.struct(-depth, F.col("id"))).alias("id"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.concat("aliases", F.array("id")))))).alias("all"))
    return kept.select("root", "id", F.array_remove("all", F.col("id")).alias("aliases"))


def macro_aliases(definitions: DataFrame) -> DataFrame:
    """(name, target): macros whose body begins with another defined macro; the first body counts."""
    rank = F.row_number().over(W.partitionBy("name").orderBy("path", "line"))
    first = definitions.withColumn("_rank", rank).where("_rank = 1").select("name", F.regexp_extract("body", r"^\s*([A-Za-z_]\w*)", 1).alias("target"))
    return first.join(first.select(F.col("name").alias("target")), "target", "left_semi").where("name <> target").select("name", "target")
