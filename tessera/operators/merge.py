"""A new extraction merged into a graph, and graphs published version by version."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import resolution as R
from tessera.operators.graph import NODE_KEY, Graph, latest
from tessera.runtime import Scratch, delete, names_in, write_once

#: (graph_id, a, b, similarity, oa, ob) of nodes: graph_id, type, id, ord, name, base_description, fresh.
Similar = Callable[[DataFrame], DataFrame]


def _by_name(nodes: DataFrame) -> DataFrame:
    """(graph_id, id, leader): rows of one id, or of one type and lower-case name, follow the first of them.

    Nodes of the graph lead, whatever their names; of several of a name the first one."""
    keyed = nodes.withColumn("key", F.lower(F.trim("name")))
    first = keyed.groupBy("graph_id", "type", "key").agg(F.min_by("id", "ord").alias("named"))
    held = nodes.where("not fresh").select(*NODE_KEY, F.lit(True).alias("held")).distinct()
    rows = keyed.join(first, ["graph_id", "type", "key"], "left").join(held, NODE_KEY, "left")
    leader = F.when(F.col("held"), F.col("id")).otherwise(F.coalesce("named", "id"))
    return rows.groupBy(*NODE_KEY).agg(F.min_by(leader, "ord").alias("leader"))


def merge(old: Graph, new: Graph, similar: Similar | None = None, aliases: DataFrame | None = None) -> tuple[Graph, DataFrame]:
    """The graph with the new nodes and edges in it, and members: graph_id, id, leader; with ``aliases``, the
    members of earlier merges, also those, and new edges may go by ids that were merged then.

    Nodes: graph_id, id, ord, name, type, base_description, base_attributes, chunk_id, perhaps states; edges as
    in ``Graph``, with chunk_id. New nodes come after those of the graph, by their ord. One of the id or of
    the type and name of an earlier node follows it; with ``similar`` the others follow their first earlier
    leader that is similar enough. Nodes of the graph are leaders and stay so: they were merged before, and
    are not compared with each other again. Only what changes is combined; ends of new edges go to the
    leaders, edges with an end that is no node go; a new edge takes the place of one of its id.

    Merging batch after batch gives the leaders of one sequential pass over all of them."""
    with Scratch(old.nodes.sparkSession) as work:
        offset = old.nodes.agg(F.max("ord")).first()[0]
        fresh = new.nodes.withColumn("ord", F.col("ord") + F.lit(0 if offset is None else offset + 1))
        rows = old.nodes.withColumn("fresh", F.lit(False)).unionByName(fresh.withColumn("fresh", F.lit(True)), allowMissingColumns=True)
        rows = work.keep(rows, "nodes")
        members = work.keep(_by_name(rows), "named")
        if similar is not None:
            heads = rows.join(members.where("id = leader").select(*NODE_KEY), NODE_KEY, "left_semi")
            heads = work.keep(heads.join(rows.where("not fresh").select(*NODE_KEY), NODE_KEY, "left_anti").unionByName(rows.where("not fresh")), "heads")
            led = R.clusters(heads, similar(heads)).select("graph_id", F.col("leader").alias("last"), F.col("id").alias("leader"))
            members = work.keep(members.join(led, ["graph_id", "leader"]).select(*NODE_KEY, F.col("last").alias("leader")), "members")
        changed = rows.where("fresh").select(*NODE_KEY).join(members, NODE_KEY).select("graph_id", "leader").distinct()
        touched = rows.join(members.join(changed, ["graph_id", "leader"], "left_semi").select(*NODE_KEY), NODE_KEY, "left_semi")
        touched = work.keep(touched, "touched")
        combined = R.combine(touched.drop("fresh"), members).drop("merged_from")
        first = touched.join(members, NODE_KEY).groupBy("graph_id", F.col("leader").alias("id")).agg(F.min("ord").alias("ord"))
        nodes = latest(old.nodes, combined.join(first, NODE_KEY), NODE_KEY)
        if aliases is not None:
            members = work.keep(members.unionByName(aliases.join(members, NODE_KEY, "left_anti")), "aliases")
        edges = latest(old.edges, R.remap_edges(new.edges.where("source is not null and target is not null"), members), NODE_KEY)
        return Graph(work.release(nodes, "nodes"), work.release(edges, "edges"), old.header), work.release(members, "members")


class GraphStore:
    """Versions of a graph in one folder. A version counts once its name is among the published ones, which is
    written last and never twice: readers see whole versions only, and of two writers of one number one fails.
    ``keep`` versions stay, for readers that have begun; older ones are deleted."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        self.spark, self.path, self.kept = spark, path, max(1, keep)

    def versions(self) -> list[int]:
        return sorted(int(n) for n in names_in(self.spark, f"{self.path}/published"))

    def read(self, version: int | None = None) -> Graph | None:
        """A version, the last one by default; None if there is none."""
        found = self.versions()
        if version is None and not found:
            return None
        at = f"{self.path}/version={found[-1] if version is None else version}"
        return Graph(self.spark.read.parquet(f"{at}/nodes"), self.spark.read.parquet(f"{at}/edges"))

    def aliases(self) -> DataFrame | None:
        """graph_id, id, leader of all nodes that were merged up to the last version."""
        found = self.versions()
        return self.spark.read.parquet(f"{self.path}/version={found[-1]}/aliases") if found else None

    def publish(self, g: Graph, members: DataFrame) -> int:
        found = self.versions()
        number = found[-1] + 1 if found else 1
        at = f"{self.path}/version={number}"
        g.nodes.write.mode("overwrite").parquet(f"{at}/nodes")
        g.edges.write.mode("overwrite").parquet(f"{at}/edges")
        members.select(*NODE_KEY, "leader").write.mode("overwrite").parquet(f"{at}/aliases")
        write_once(self.spark, f"{self.path}/published/{number}")
        for n in [*found, number][: -self.kept]:
            delete(self.spark, f"{self.path}/published/{n}")
            delete(self.spark, f"{self.path}/version={n}")
        return number

    def merge(self, new: Graph, similar: Similar | None = None) -> int:
        """Merges into the last version and publishes the next one."""
        old = self.read()
        if old is None:
            old = Graph(new.nodes.limit(0), new.edges.limit(0))
        return self.publish(*merge(old, new, similar, self.aliases()))

