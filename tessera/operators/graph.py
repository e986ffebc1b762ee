"""Dependency graphs as edge tables: resolution, degrees, reachability, cycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import normal_path
from tessera.session import cut

# Endings that an import may leave out, endings tried for a relative import in this order, and for others.
KNOWN_ENDINGS = ("ts", "tsx", "js", "jsx", "py", "go", "java", "kt", "php", "rs")
RELATIVE = ("", ".ts", ".tsx", "/index.ts", "/index.tsx", ".js", ".vue", ".py", "/__init__.py", ".go", ".java", ".kt", ".php", ".rs")
ABSOLUTE = (".ts", ".tsx", "/index.ts", ".py", "/__init__.py", ".go", ".java", ".kt", ".php", ".rs", "")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Adds resolved: the file an import names, null if it names none of ``files``.

    imports has src_file, target_path and repo; files has file_path and repo. A known ending of the target is left out. A
    relative target is joined to the importing file's directory (python's leading dots go up) and tried with each ending
    of RELATIVE; the first that is a file of the same repository wins. Others lose a leading ``@/`` or ``~/``, dots become
    slashes where there is no slash, and the least file whose path ends with one of the ABSOLUTE forms wins. Targets
    beginning with ``pkg:`` name packages. Files are indexed by path and by every suffix of it, one file a key, so this is
    one equi-join on (repo, key), and a repository with many files is no scan for each import.
    """
    directory = F.regexp_replace("src_file", "[^/]*$", "")
    target = F.col("target_path")
    base = F.regexp_replace(target, rf"\.({'|'.join(KNOWN_ENDINGS)})$", "")
    dots = F.length(F.regexp_extract(target, r"^(\.+)[^./]*", 1))
    python = target.rlike(r"^\.+[A-Za-z_]")
    up = F.when(python, F.concat(F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0))), F.translate(F.regexp_replace(target, r"^\.+", ""), ".", "/"))).otherwise(base)
    path = normal_path(F.concat(directory, up))
    clean = F.when(~F.contains(base, F.lit("/")) & F.contains(base, F.lit(".")), F.translate(base, ".", "/")).otherwise(F.regexp_replace(base, "^[@~]/", ""))
    near = F.array(*[F.struct(F.lit(k).alias("rank"), F.concat(F.lit("="), path, F.lit(s)).alias("key")) for k, s in enumerate(RELATIVE)])
    far = F.array(*[F.struct(F.lit(0).alias("rank"), F.concat(F.lit("/"), clean, F.lit(s)).alias("key")) for s in ABSOLUTE])
    known = imports.where(~target.startswith("pkg:")).select("repo", "src_file", "target_path").distinct()
    wanted = known.select("repo", "src_file", "target_path", F.explode(F.when(target.startswith("."), near).otherwise(far)).alias("c")).select("repo", "src_file", "target_path", "c.*")
    parts = F.split("file_path", "/")
    suffixes = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(parts, k, F.size(parts)), "/"))))
    keys = files.select("repo", "file_path", F.explode(F.concat(F.array(F.concat(F.lit("="), "file_path")), F.coalesce(suffixes, F.array().cast("array<string>")))).alias("key"))
    index = keys.groupBy("repo", "key").agg(F.min("file_path").alias("file_path"))
    hits = wanted.join(index, ["repo", "key"]).groupBy("repo", "src_file", "target_path").agg(F.min(F.struct("rank", "file_path")).alias("best"))
    return imports.join(hits.select("repo", "src_file", "target_path", F.col("best.file_path").alias("resolved")), ["repo", "src_file", "target_path"], "left")


def in_degrees(edges: DataFrame) -> DataFrame:
    """(dst, n): distinct sources of each destination."""
    return edges.select("src", "dst").distinct().groupBy("dst").agg(F.count(F.lit(1)).alias("n"))


def reachable(edges: DataFrame, start: DataFrame, most: int | None = None, origin: str | None = None) -> DataFrame:
    """(node, depth): what is reached from ``start`` (column node) along edges (src, dst), with the least depth.

    With ``origin``, a column of start, (origin, node, depth): what is reached from each of them by itself. Breadth first; each
    round joins the new nodes only and is written to the shared folder, so that lineage stays short. A start node appears
    only if an edge leads back to it. Ends when nothing new is found, or after ``most`` rounds if given.
    """
    steps = cut(edges.select("src", "dst").distinct())
    keys = [origin, "node"] if origin else ["node"]
    frontier, seen, depth = start.select(*keys).distinct(), None, 0
    while most is None or depth < most:
        depth += 1
        new = frontier.join(steps, frontier["node"] == steps["src"]).select(*keys[:-1], F.col("dst").alias("node")).distinct()
        if seen is not None:
            new = new.join(seen.select(*keys), keys, "left_anti")
        new = cut(new.withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            break
        seen = new if seen is None else seen.unionByName(new)
        if depth % 16 == 0:
            seen = cut(seen.coalesce(max(1, new.rdd.getNumPartitions())))
        frontier = new.select(*keys)
    return seen if seen is not None else frontier.limit(0).withColumn("depth", F.lit(0))


def components(closure: DataFrame, origin: str) -> DataFrame:
    """(node, component, size): nodes on cycles of any length with the least node of their strongly connected component.

    closure is what reachable gives for every node by itself.
    """
    there = closure.select(F.col(origin).alias("node"), F.col("node").alias("other"))
    back = there.select(F.col("other").alias("node"), F.col("node").alias("other"))
    return there.join(back, ["node", "other"]).groupBy("node").agg(F.min("other").alias("component"), F.count(F.lit(1)).alias("size"))


def cycles(edges: DataFrame, longest: int) -> DataFrame:
    """(members, length): elementary cycles of up to ``longest`` edges, once per set of members.

    Nodes without an edge in or out are on no cycle and are taken off first, ``longest`` times over. Paths grow from their
    least node only, which keeps one rotation of each cycle and prunes the others early. The number of paths grows with
    the degree, inside the parts that have cycles, to the power of ``longest``.
    """
    steps = edges.select("src", "dst").distinct()
    for _ in range(longest):
        steps = cut(steps.join(steps.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").join(steps.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst"))
    paths = steps.where("dst >= src").select(F.array("src").alias("path"), F.col("dst").alias("last"))
    found = None
    for length in range(1, longest + 1):
        closed = paths.where(F.col("last") == F.col("path")[0]).select(F.array_join(F.array_sort(F.transform("path", lambda x: x.cast("string"))), ">").alias("members"), F.lit(length).alias("length"))
        found = closed if found is None else found.unionByName(closed)
        if length < longest:
            going = paths.where(F.col("last") > F.col("path")[0]).where(~F.array_contains("path", F.col("last")))
            grown = going.select(F.array_append("path", F.col("last")).alias("path"), F.col("last").alias("src"))
            paths = grown.join(steps, "src").where(F.col("dst") >= F.col("path")[0]).select("path", F.col("dst").alias("last"))
    return found.groupBy("members").agg(F.min("length").alias("length"))


def fans(edges: DataFrame, preview: int = 10) -> DataFrame:
    """(node, fan_in, fan_out, importers): degrees, and the first importers in order, at most ``preview``.

    Importers are cut to the first few by rank before they are gathered, so a hub is no unbounded list.
    """
    pairs = edges.select("src", "dst").distinct()
    into = pairs.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("fan_in"))
    out = pairs.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("fan_out"))
    first = pairs.withColumn("rn", F.row_number().over(Window.partitionBy("dst").orderBy("src"))).where(F.col("rn") <= preview)
    shown = first.groupBy(F.col("dst").alias("node")).agg(F.array_join(F.array_sort(F.collect_list("src")), ",").alias("importers"))
    return into.join(out, "node", "full").join(shown, "node", "left").na.fill(0, ["fan_in", "fan_out"])


def winners(rows: DataFrame, key: str, rank: Column, *order) -> DataFrame:
    """The row of greatest rank per key; ties by ``order``."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(rank.desc(), *order))
    return rows.withColumn("place", place).where("place = 1").drop("place")


def tagged(kind: Column, score: Column) -> tuple[Column, Column]:
    """(confidence, score) by the kind of producer: ast is certain, llm and hybrid depend on a score, others are ambiguous."""
    bad = score.isNull() | F.isnan(score) | (F.abs(score) == float("inf"))
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    confidence = (
        F.when(kind == "ast", "EXTRACTED").when((kind == "llm") & ~bad, "INFERRED").when((kind == "hybrid") & ~bad & (clamped >= 0.5), "INFERRED").otherwise("AMBIGUOUS")
    )
    return confidence, F.when(kind == "ast", F.lit(1.0)).when(kind.isin("llm", "hybrid") & ~bad, clamped)
