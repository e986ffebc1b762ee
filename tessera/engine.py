"""The library's front: tools by name over the tables of one folder, and the tables as SQL views."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import PurePath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import graph, retrieval
from tessera.sources.tables import distinct_chunks, table

TABLES = ("repos", "code_chunks", "symbols", "imports", "file_hashes", "ai_request_metrics", "documents")


class InvalidArgument(ValueError):
    """A tool was called with an argument that it doesn't take."""


@dataclass(frozen=True)
class Parameter:
    """A tool's parameter: its type, whether it must be given, and its values if they are few."""

    kind: type
    required: bool = False
    values: tuple[str, ...] = ()


#: Parameters of each tool.
PARAMETERS: dict[str, dict[str, Parameter]] = {
    "search_codebase": {"query": Parameter(str, True), "top_k": Parameter(int)},
    "search_code": {"query": Parameter(str, True), "top_k": Parameter(int)},
    "find_symbol": {"name": Parameter(str, True), "limit": Parameter(int)},
    "find_dependencies": {"target": Parameter(str, True), "direction": Parameter(str, values=("upstream", "downstream", "both"))},
    "get_module_summary": {"module": Parameter(str, True)},
    "get_api_endpoints": {"module": Parameter(str)},
    "graph_analysis": {"kind": Parameter(str, True, ("hotspots", "cycles", "impact", "tree")), "target": Parameter(str)},
    "query_code_graph": {"file": Parameter(str, True)},
}
#: Calls that the history keeps.
HISTORY = 100


class Engine:
    """Tools over the Parquet tables under ``root``; every tool returns a lazy DataFrame."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, str(PurePath(root))
        self.tools: dict[str, Callable[..., DataFrame]] = {
            "search_codebase": self.search_codebase,
            "find_symbol": self.find_symbol,
            "find_dependencies": self.find_dependencies,
            "get_module_summary": self.get_module_summary,
            "graph_analysis": self.graph_analysis,
            "search_code": self.search_codebase,
            "get_api_endpoints": self.get_api_endpoints,
            "query_code_graph": self.query_code_graph,
        }
        self.history: deque[tuple[str, dict]] = deque(maxlen=HISTORY)

    def register_views(self) -> None:
        """Make the tables available to ``spark.sql`` under their names."""
        for name in TABLES:
            table(self.spark, self.root, name).createOrReplaceTempView(name)

    def call(self, tool: str, **arguments) -> DataFrame:
        """Run a tool by name; unknown tools and parameters, missing or blank ones, wrong types and values are refused."""
        if tool not in self.tools:
            raise InvalidArgument(f"unknown tool {tool}")
        known = PARAMETERS[tool]
        for name, value in arguments.items():
            if name not in known:
                raise InvalidArgument(f"{tool} takes no {name}")
            if value is not None and (not isinstance(value, known[name].kind) or isinstance(value, bool)):
                raise InvalidArgument(f"{name} is no {known[name].kind.__name__}")
            if isinstance(value, str) and not value.strip():
                raise InvalidArgument(f"{name} is blank")
            if known[name].values and value is not None and value not in known[name].values:
                raise InvalidArgument(f"{name} is none of {', '.join(known[name].values)}")
        missing = [name for name, p in known.items() if p.required and arguments.get(name) is None]
        if missing:
            raise InvalidArgument(f"{tool} needs {', '.join(missing)}")
        self.history.append((tool, arguments))
        return self.tools[tool](**arguments)

    def search_codebase(self, query: str, top_k: int = 8) -> DataFrame:
        """The chunks with the best lexical score for the words of ``query``; top_k is limited to 1..20."""
        tokens = [t for t in dict.fromkeys("".join(c.lower() if c.isalnum() else " " for c in query).split()) if len(t) > 2][:6]
        if not tokens:
            raise InvalidArgument("query has no word of three characters")
        return retrieval.keyword(distinct_chunks(self.spark, self.root, "file_path", "line_start", "content"), "chunk_id", "content", tokens, min(20, max(1, top_k)))

    def find_symbol(self, name: str, limit: int = 10) -> DataFrame:
        """Symbols of that name first, then those whose qualified name contains it, without regard to case."""
        rows = table(self.spark, self.root, "symbols").where((F.col("name") == name) | F.contains(F.lower("qualified"), F.lit(name.lower())))
        return rows.orderBy((F.col("name") == name).desc(), "qualified", "node_id").limit(limit)

    def find_dependencies(self, target: str, direction: str = "both") -> DataFrame:
        """(direction, other): what imports ``target`` (upstream) and what it imports (downstream)."""
        if direction not in ("upstream", "downstream", "both"):
            raise InvalidArgument(f"direction {direction}")
        rows = table(self.spark, self.root, "imports")
        up = rows.where(F.col("target_path") == target).select(F.lit("upstream").alias("direction"), F.col("src_file").alias("other"))
        down = rows.where(F.col("src_file") == target).select(F.lit("downstream").alias("direction"), F.col("target_path").alias("other"))
        parts = {"upstream": up, "downstream": down, "both": up.unionByName(down)}
        return parts[direction].distinct().orderBy("direction", "other")

    def get_module_summary(self, module: str) -> DataFrame:
        """Files of a module with their span of lines."""
        rows = distinct_chunks(self.spark, self.root, "module_name", "file_path", "line_start", "line_end").where(F.col("module_name") == module)
        return rows.groupBy("file_path").agg(F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end")).orderBy("file_path")

    def get_api_endpoints(self, module: str | None = None) -> DataFrame:
        """Verb, path and handler of the decorated routes, of one module or all."""
        from tessera.plans.structure_queries import endpoints

        found = endpoints(self.spark, self.root)
        if module is None:
            return found
        own = distinct_chunks(self.spark, self.root, "module_name").where(F.col("module_name") == module).select("chunk_id")
        return found.join(own, "chunk_id", "left_semi")

    def query_code_graph(self, file: str) -> DataFrame:
        """Files that import the best match of ``file``: the path itself or the shortest that ends with it."""
        from tessera.plans.graph_queries import resolved_edges

        found = resolved_edges(self.spark, self.root).withColumn("path", F.regexp_replace("dst", "^[^:]*:", ""))
        matching = found.where((F.col("path") == file) | F.col("path").endswith(f"/{file}"))
        best = matching.groupBy("dst").agg(F.min(F.length("path")).alias("n")).orderBy("n", "dst").limit(1).select("dst")
        return found.join(F.broadcast(best), "dst", "left_semi").select(F.col("src").alias("dependent"), F.col("dst").alias("file")).distinct()

    def graph_analysis(self, kind: str, target: str | None = None) -> DataFrame:
        """``hotspots``, ``cycles`` (up to 5 edges), ``tree`` (what each file imports) or ``impact`` of a target (everything that depends on it)."""
        edges = table(self.spark, self.root, "imports").select(F.col("src_file").alias("src"), F.col("target_path").alias("dst"))
        if kind == "hotspots":
            return graph.in_degrees(edges).orderBy(F.desc("n"), "dst").limit(20)
        if kind == "tree":
            return edges.where(F.col("src") == target).distinct() if target else edges.distinct()
        if kind == "cycles":
            return graph.cycles(edges, 5)
        if kind == "impact" and target:
            back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
            return graph.reachable(back, back.where(F.col("src") == target).select(F.col("src").alias("node")))
        raise InvalidArgument(f"analysis {kind}")
