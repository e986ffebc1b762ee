"""Source trees as tables: listing, ignoring, classifying."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import language_of

# Parts of paths never indexed, endings never indexed, endings that are.
EXCLUDED_PARTS = ("node_modules/", "dist/", ".git/", "/migrations/")
EXCLUDED_ENDINGS = (".spec.ts", ".test.ts", ".e2e-spec.ts", ".json", ".lock", ".env", ".png", ".jpg", ".jpeg", ".gif", ".pdf", ".zip", ".ico", ".svg", ".woff", ".woff2", ".ttf", ".eot")
INDEXED_ENDINGS = (
    ".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".py", ".go", ".java", ".kt", ".kts", ".rs", ".swift", ".php", ".vue", ".svelte", ".md", ".mdx", ".yml", ".yaml", ".sql", ".prisma",
    ".graphql", ".gql", ".proto", ".tf", ".tfvars",
)
#: Kinds of context artifacts by patterns on the file name or the path, in this order; paths that are none.
ARTIFACTS = (
    (r"\.(sql)$", "schema"), (r"schema\.(ts|js|prisma)$", "schema"), (r"\.(prisma)$", "schema"), (r"\.(yaml|yml)$", "openapi"), (r"openapi\.(json)$", "openapi"), (r"swagger\.(json|yaml|yml)$", "openapi"),
    (r"\.(tf|tfvars)$", "terraform"), (r"\.(graphql|gql)$", "graphql"), (r"\.(proto)$", "proto"), (r"^(architecture|adr|design|api|database|schema|readme)\.(md|mdx)$", "markdown"),
    (r"/(docs?|documentation|architecture|adr)/", "markdown"),
)
NO_ARTIFACT = ("node_modules/", "dist/", ".git/", "coverage/", "test/", "__tests__/")
#: Roles by the ending of a path, before those by decorators.
ROLE_ENDINGS = ("entity", "dto", "guard", "interceptor", "filter", "pipe", "middleware", "strategy", "decorator")
MOST_BYTES = 1 << 20


def should_index(path: Column) -> Column:
    """Whether a path is indexed: no hidden part, no excluded part or ending, a known ending; case doesn't count. Null paths are not."""
    low = F.lower(path)
    hidden = F.exists(F.split(low, "/"), lambda p: p.startswith(".") & (F.length(p) > 1))
    inside, ends, known = F.lit(False), F.lit(False), F.lit(False)
    for part in EXCLUDED_PARTS:
        inside = inside | F.contains(low, F.lit(part))
    for ending in EXCLUDED_ENDINGS:
        ends = ends | low.endswith(ending)
    for ending in INDEXED_ENDINGS:
        known = known | low.endswith(ending)
    return F.coalesce(~hidden & ~inside & ~ends & known, F.lit(False))


def artifact_kind(path: Column) -> Column:
    """Kind of a context artifact by the first of an ordered list of patterns; null for ordinary files and excluded paths."""
    low = F.lower(path)
    name = F.substring_index(low, "/", -1)
    out = F.when(low.isNull(), F.lit(None).cast("string"))
    for part in NO_ARTIFACT:
        out = out.when(F.contains(low, F.lit(part)), F.lit(None).cast("string"))
    for pattern, kind in ARTIFACTS:
        out = out.when(name.rlike(pattern) | low.rlike(pattern), kind)
    return out


def nest_role(path: Column, decorators: Column) -> Column:
    """Role of a file by the ending of its path, else by the decorators of its symbols, else ``unknown``."""
    out = F.when(path.isNull(), "unknown")
    for role in ROLE_ENDINGS:
        out = out.when(path.endswith(f".{role}.ts"), role)
    has = lambda name: F.coalesce(F.array_contains(decorators, name), F.lit(False))
    out = out.when(has("Controller"), "controller").when(has("Injectable") & F.contains(path, F.lit("service")), "service").when(has("Module"), "module")
    return out.when(has("Injectable"), "service").otherwise("unknown")


#: Roles by framework, patterns on the lower-case path in this order; ``*`` stands for any other file of the framework.
FRAMEWORK_ROLES = {
    "nextjs": ((r"(^|/)page\.(tsx|ts|jsx)$", "page"), (r"(^|/)layout\.tsx?$", "layout"), (r"(^|/)loading\.tsx$", "loading"), (r"(^|/)error\.tsx$", "error"), (r"/api/(.*/)?route\.(ts|js)$", "api-route"), (r"middleware", "middleware"),
               (r"/components?/", "component"), (r"/hooks/|(^|/)use[^/]*$", "hook"), (r"/(lib|utils)/", "utility"), (r"/(types|interfaces)/", "type"), ("", "component")),
    "vite-react": ((r"/hooks/|(^|/)use[^/]*$", "hook"), (r"/(store|redux|zustand)/", "store"), (r"/(services|api)/", "service"), (r"/(utils|helpers)/", "utility"), (r"/(types|interfaces)/", "type"), (r"/(pages|views)/.*\.[tj]sx$", "page"), (r"\.[tj]sx$", "component")),
    "vite-vue": ((r"/(stores|pinia|store)/", "store"), (r"/composables/|(^|/)use[^/]*$", "composable"), (r"/(services|api)/", "service"), (r"/(utils|helpers)/", "utility"), (r"/(types|interfaces)/", "type"), (r"/(views|pages)/.*\.vue$", "view"), (r"/layouts/.*\.vue$", "layout"), (r"\.vue$", "component")),
    "angular": tuple((rf"\.{r}\.[^/]*$", r) for r in ("component", "service", "module", "guard", "interceptor", "pipe", "directive", "resolver")) + ((r"\.(model|interface)\.[^/]*$", "model"),),
    "sveltekit": ((r"(^|/)\+server\.(ts|js)$", "api-route"), (r"/stores/|/store\.", "store"), (r"(^|/)\+page\.svelte$", "page"), (r"(^|/)\+layout\.svelte$|/layouts/", "layout"), (r"(^|/)\+error\.svelte$", "error"), (r"/routes/.*\.svelte$", "route"), (r"\.svelte$", "component"), (r"/lib/", "utility")),
    "fastapi": ((r"model[^/]*$", "model"), (r"view[^/]*$", "view"), (r"(^|/)serializers\.py$", "serializer"), (r"(^|/)urls\.py$|router[^/]*$|/routers/", "router"), (r"schema[^/]*$", "schema"), (r"middleware[^/]*$", "middleware"), (r"(^|/)(settings|config)\.py$", "config")),
}


def framework_role(path: Column, framework: str) -> Column:
    """Role of a file in a framework; null where it has none or the framework has no roles."""
    out = F.when(path.isNull(), F.lit(None).cast("string"))
    for pattern, role in FRAMEWORK_ROLES.get({"svelte": "sveltekit", "django": "fastapi"}.get(framework, framework), ()):
        out = out.when(F.lower(path).rlike(pattern), role)
    return out


def source_tree(spark: SparkSession, root: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, length, text, language, sha256) of the files under ``root`` that are indexed.

    Size and path are filtered before contents are read into rows; unreadable bytes become U+FFFD. An empty or missing
    match gives no rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= most_bytes)
    relative = F.regexp_replace(F.col("path"), "^(?:file:)?/*" + "/*" + root.strip("/").replace(".", r"\.") + "/", "")
    rows = files.select(relative.alias("path"), "length", "content").where(should_index(F.col("path")))
    return rows.select("path", "length", F.make_valid_utf8(F.col("content").cast("string")).alias("text"), language_of(F.col("path")).alias("language"), F.sha2("content", 256).alias("sha256"))


def framework_of(files: DataFrame, repo: str) -> DataFrame:
    """(repo, framework) by the files a repository has, in order of preference; one aggregate, no file is read twice."""
    path = F.col("file_path")
    nest, spring, express = path.rlike(r"\.(module|controller|service)\.ts$"), path.rlike(r"src/main/java/"), path.rlike(r"\.m?js$")
    by = files.groupBy(repo).agg(*[F.bool_or(c).alias(n) for c, n in ((nest, "nest"), (spring, "spring"), (express, "express"))])
    return by.select(repo, F.when(F.col("nest"), "nestjs").when(F.col("spring"), "spring").when(F.col("express"), "express").alias("framework"))


# Files in a repository's upper two levels that say what it is built with, in this order.
SIGNALS = (
    ("next.config.js", "nextjs"), ("next.config.ts", "nextjs"), ("next.config.mjs", "nextjs"), ("vite.config.ts", "vite-react"), ("vite.config.js", "vite-react"), ("vite.config.mts", "vite-react"), ("angular.json", "angular"),
    (".angular-cli.json", "angular"), ("svelte.config.js", "svelte"), ("svelte.config.ts", "svelte"), ("nuxt.config.ts", "nuxt"), ("nuxt.config.js", "nuxt"),
)
READ = ("package.json", "requirements.txt", "pom.xml", "vite.config.ts", "vite.config.js", "vite.config.mts")


def detected_framework(paths: DataFrame, texts: DataFrame, repo: str) -> DataFrame:
    """(repo, framework): what a repository is built with, by its manifest, signal files, requirements and build files; else ``unknown``.

    paths has repo and file_path of all files, texts also the text of those READ in the root. One aggregate over each.
    """
    path = F.lower("file_path")
    upper = F.size(F.split(path, "/")) <= 2
    has = lambda c, name: F.coalesce(F.bool_or(c), F.lit(False)).alias(name)
    seen = paths.groupBy(repo).agg(
        *[has(upper & (F.substring_index(path, "/", -1) == f), f"s{k}") for k, (f, _) in enumerate(SIGNALS)],
        has(F.contains(F.col("file_path"), F.lit("pom.xml")) | F.contains(F.col("file_path"), F.lit("build.gradle")), "build"),
    )
    says = lambda file, *words: (F.col("file_path") == file) & F.coalesce(F.expr(" OR ".join(f"contains(text, '{w}')" for w in words)), F.lit(False))
    vite = F.col("file_path").startswith("vite.config.")
    read = texts.groupBy(F.col(repo).alias("_repo")).agg(
        has(says("package.json", "@nestjs/core"), "nest"), has(says("package.json", '"express"'), "express"), has((F.col("file_path") == "package.json") & (F.length("text") > 0), "manifest"),
        has(says("requirements.txt", "fastapi"), "fastapi"), has(says("requirements.txt", "django"), "django"), has(says("pom.xml", "spring-boot"), "spring"),
        has(vite & (F.contains("text", F.lit("@vitejs/plugin-vue")) | F.contains("text", F.lit("vue()"))), "vue"), has(vite & (F.contains("text", F.lit("@sveltejs/kit")) | F.contains("text", F.lit("sveltekit"))), "kit"),
    )
    both = seen.join(read, seen[repo].eqNullSafe(read["_repo"]), "left").drop("_repo").na.fill(False)
    out = F.when(F.col("nest"), "nestjs")
    for k, (_, name) in enumerate(SIGNALS):
        out = out.when(F.col(f"s{k}"), F.when(F.col("vue"), "vite-vue").when(F.col("kit"), "sveltekit").otherwise(name) if name == "vite-react" else F.lit(name))
    out = out.when(~F.col("manifest") & F.col("fastapi"), "fastapi").when(~F.col("manifest") & F.col("django"), "django").when(F.col("build") & F.col("spring"), "spring").when(F.col("express"), "express")
    return both.select(repo, out.otherwise("unknown").alias("framework"))
