"""Operators on small tables: nulls, ties, repeats, empty tables, clashing names; and against plain Python."""

import hashlib
import posixpath
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import extract, graph, quality, retrieval, sequence, skew, store, telemetry
from tessera.sources import scan


def values(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=str)


SKEWED = [("a", k % 7) for k in range(500)] + [("b", 3), ("b", None), (None, 1), (None, 1), ("c", None), ("d", -5), ("d", 1 << 40)]


def test_key_summary_matches_plain_counts(spark):
    got = {r["key"]: r for r in skew.key_summary(spark.createDataFrame(SKEWED, "k string, v long"), "k", "v").collect()}
    groups = defaultdict(list)
    for k, v in SKEWED:
        groups[k].append(v)
    for k, rows in groups.items():
        real = [v for v in rows if v is not None]
        counts = Counter(real)
        mode = min((v for v in counts if counts[v] == max(counts.values())), default=None)
        assert (got[k]["n_rows"], got[k]["n_values"], got[k]["n_distinct"], got[k]["mode"]) == (len(rows), len(real), len(counts), mode)
        assert got[k]["total"] == (sum(real) if real else None)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["x", "y", None]), st.one_of(st.none(), st.integers(-(10**9), 10**9))), max_size=60))
def test_key_percentiles_match_sorting(spark, rows):
    frame = spark.createDataFrame(rows, "k string, v long")
    got = {(r["key"], r["p"]): r["value"] for r in skew.key_percentiles(frame, "k", "v", (0.0, 0.5, 1.0)).collect()}
    groups = defaultdict(list)
    for k, v in rows:
        if v is not None:
            groups[k].append(v)
    want = {(k, p): sorted(v)[max(1, -(-int(p * 2 * len(v)) // 2)) - 1] for k, v in groups.items() for p in (0.0, 0.5, 1.0)}
    assert got == want


def test_skew_on_empty_and_clashing_names(spark):
    empty = spark.createDataFrame([], "key string, value long, freq int, bucket int")
    assert skew.key_summary(empty, "key", "value").count() == 0
    assert skew.key_percentiles(empty, "key", "value", (0.5,)).count() == 0
    full = spark.createDataFrame([("k", 4, 1, 1), ("k", 4, 2, 9)], empty.schema)
    assert values(skew.key_percentiles(full, "key", "value", (0.5,)), "key", "value") == [("k", 4)]
    assert values(skew.heavy_keys(full, "key", "freq", 0.5), "key", "n") == [("k", 2)]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "..", ".", "", "c.ts"]), min_size=1, max_size=7))
def test_normal_path(spark, parts):
    got = spark.range(1).select(X.normal_path(F.lit("/".join(parts)))).first()[0]
    assert got == posixpath.normpath("/" + "/".join(parts)).strip("/")


def test_ids_and_tokens(spark):
    row = spark.createDataFrame([("a/b.ts", "class", None, "HTTPServer parseJson and the tokens")], "p string, k string, n string, t string")
    got = row.select(X.hex_id(F.col("p"), F.col("k")).alias("i"), X.hex_id(F.col("p"), F.col("n")).alias("none"), X.search_tokens(F.col("t")).alias("t")).first()
    assert got["i"] == hashlib.sha256("a/b.ts\x1fclass".encode()).hexdigest()[:16]
    assert got["none"] is None
    assert got["t"] == ["httpserver", "parse", "json", "tokens"]


def test_vectors_with_nulls_and_zeros(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.6, 0.8]), ("n", None), ("z", [0.0, 0.0]), ("w", [1.0]), ("x", [float("nan"), 1.0]), ("c", [1.0, 0.0])], "id string, v array<float>")
    keep = rows.where(retrieval.usable_vector(F.col("v"), 2)).withColumn("q", F.array(F.lit(1.0), F.lit(0.0)))
    got = {r["id"]: r for r in keep.select("id", F.round(X.cosine(F.col("v"), F.col("q")), 6).alias("c"), X.distance(F.col("v"), F.col("q")).alias("d")).collect()}
    assert set(got) == {"a", "b", "c"} and got["b"]["c"] == 0.6 and got["a"]["d"] == 0


def test_keyword_search_ties_and_nulls(spark):
    rows = spark.createDataFrame([(1, "Ledger ledger"), (2, "quiver"), (3, None), (4, ""), (5, "quiver"), (6, "ledgers")], "id int, t string")
    assert [r["id"] for r in retrieval.keyword(rows, "id", "t", ["ledger", "quiver"], 5).collect()] == [1, 2, 5]


def test_upsert_latest_wins(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 5, "y"), (None, 1, "n")], "k string, v int, t string")
    new = spark.createDataFrame([("a", 1, "X"), ("b", 4, "Y"), ("c", 1, "z")], old.schema)
    assert values(store.upsert(old, new, ["k"], "v"), "k", "t") == [("a", "X"), ("b", "y"), ("c", "z"), (None, "n")]
    assert values(store.replace_files(old, new, "k"), "k", "t") == [("a", "X"), ("b", "Y"), ("c", "z"), (None, "n")]
    assert values(store.append_missing(old, new, ["k"]), "k") == [("c",)]
    empty = old.limit(0)
    assert store.upsert(empty, empty, ["k"], "v").count() == 0


def test_eviction_takes_the_oldest(spark):
    rows = spark.createDataFrame([(k, 10, f"2025-01-0{1 + k // 3} 0{k % 3}:00:00") for k in range(9)] + [(9, None, None)], "id int, n int, t string")
    rows = rows.withColumn("t", F.to_timestamp("t"))
    assert [r["id"] for r in store.evict(rows, "n", "t", "id", 35).orderBy("id").collect()] == [0, 1, 2, 3, 4, 5, 9]
    assert store.evict(rows, "n", "t", "id", 1000).count() == 0


def test_cooldown_and_bucket(spark):
    rows = spark.createDataFrame([("a", t, t) for t in (0, 5, 10, 14, 25)] + [("b", 3, 3), (None, 1, 1)], "k string, t long, i long")
    assert values(sequence.cooled_down(rows, "k", "t", "i", 10), "k", "i") == [("a", 0), ("a", 10), ("a", 25), ("b", 3), (None, 1)]
    paid = spark.createDataFrame([("r", 0, 1, 990.0), ("r", 0, 2, 1000.0)], "k string, t long, i long, c double")
    assert values(sequence.token_bucket(paid, "k", "t", "i", "c", 1000.0, 50.0), "i", "ok", "retry_ms") == [(1, True, 0), (2, False, 19800)]


EDGES = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d"), ("e", "a"), ("a", "b")]


def test_reachability_and_cycles(spark):
    edges = spark.createDataFrame(EDGES, "src string, dst string")
    start = spark.createDataFrame([("a",)], "node string")
    assert values(graph.reachable(edges, start), "node", "depth") == [("a", 3), ("b", 1), ("c", 2), ("d", 3)]
    assert values(graph.cycles(edges, 5), "members", "length") == [("a>b>c", 3), ("d", 1)]
    nowhere = spark.createDataFrame([("zz",)], "node string")
    assert graph.reachable(edges, nowhere).count() == 0
    assert values(graph.in_degrees(edges), "dst", "n") == [("a", 2), ("b", 1), ("c", 1), ("d", 2)]


def test_reachability_has_no_last_round(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(68)], "src int, dst int").coalesce(1)
    got = {r["node"]: r["depth"] for r in graph.reachable(edges, spark.createDataFrame([(0,)], "node int").coalesce(1)).collect()}
    assert got == {k: k for k in range(1, 69)}


def test_import_graph_is_searched_for_impact_and_cycles(spark, tmp_path):
    """A cycle of seven files, one of two, a file that imports into it, and the same names in another repository."""
    wanted = [(f"c{k}.ts", f"./c{(k + 1) % 7}") for k in range(7)] + [("a.ts", "./b"), ("b.ts", "./a"), ("x.ts", "./a"), ("y.ts", "pkg:fs")]
    chunks = [(f"r:{f}", f"{f}", "s/" + f, "r") for f, _ in wanted] + [("q:a", "qa", "s/a.ts", "q"), ("q:b", "qb", "s/b.ts", "q")]
    imports = [(f"{k}", f, "s/" + f, t, "EXTRACTED") for k, (f, t) in enumerate(wanted)] + [("q", "qa", "s/a.ts", "./b", "EXTRACTED")]
    spark.createDataFrame(chunks, "chunk_id string, file_id string, file_path string, repo_id string").write.parquet(f"{tmp_path}/code_chunks.parquet")
    spark.createDataFrame(imports, "edge_id string, file_id string, src_file string, target_path string, confidence string").write.parquet(f"{tmp_path}/imports.parquet")
    from tessera.plans.graph_queries import QUERIES

    impact = {(r["file"], r["impacted"]): r["depth"] for r in QUERIES["import_impact"](spark, str(tmp_path)).collect()}
    assert {k: v for k, v in impact.items() if k[0] == "r:s/b.ts"} == {("r:s/b.ts", "r:s/a.ts"): 1, ("r:s/b.ts", "r:s/b.ts"): 2, ("r:s/b.ts", "r:s/x.ts"): 2}
    assert impact["r:s/c0.ts", "r:s/c1.ts"] == 6 and [k for k in impact if k[0].startswith("q")] == [("q:s/b.ts", "q:s/a.ts")]
    assert values(QUERIES["import_cycles"](spark, str(tmp_path)), "members", "length") == [("r:s/a.ts>r:s/b.ts", 2)]
    assert values(QUERIES["import_components"](spark, str(tmp_path)), "component", "size") == [("r:s/a.ts", 2)] * 2 + [("r:s/c0.ts", 7)] * 7


def test_import_resolution(spark):
    files = spark.createDataFrame([("r", p) for p in ("s/a.ts", "s/b.ts", "s/c/index.ts", "p/m.py", "p/q/n.py", "s/b.js")] + [("other", "s/z.ts")], "repo string, file_path string")
    wanted = [("s/a.ts", "./b", "s/b.ts"), ("s/a.ts", "./c", "s/c/index.ts"), ("s/c/index.ts", "../a", "s/a.ts"), ("s/a.ts", "./z", None), ("s/a.ts", "pkg:fs", None), ("p/q/n.py", "..m", "p/m.py"), ("p/m.py", ".q.n", "p/q/n.py"), ("s/a.ts", "./b.js", "s/b.ts")]
    imports = spark.createDataFrame([("r", a, t) for a, t, _ in wanted], "repo string, src_file string, target_path string")
    got = {(r["src_file"], r["target_path"]): r["resolved"] for r in graph.resolve_imports(imports, files).collect()}
    expected = {(a, t): x for a, t, x in wanted}
    # a known ending is left out first, and .ts is tried before .js
    assert got == expected


def test_imports_by_suffix(spark):
    """Aliased and dotted imports: the least file whose path ends with one of the forms; no suffix inside a name."""
    files = spark.createDataFrame([("r", p) for p in ("src/app/user.ts", "lib/app/user.ts", "src/app/index.ts", "py/app/models/user.py", "src/main/java/dev/a/Shop.java", "user.ts", "x/my-user.ts")], "repo string, file_path string")
    wanted = [("@/app/user", "lib/app/user.ts"), ("~/app/user.ts", "lib/app/user.ts"), ("app", "src/app/index.ts"), ("app.models.user", "py/app/models/user.py"), ("dev.a.Shop", "src/main/java/dev/a/Shop.java"), ("user", "lib/app/user.ts"), ("nothing", None), ("pkg:app", None)]
    imports = spark.createDataFrame([("r", "src/z.ts", t) for t, _ in wanted], "repo string, src_file string, target_path string")
    assert {r["target_path"]: r["resolved"] for r in graph.resolve_imports(imports, files).collect()} == dict(wanted)


def test_confidence_policy(spark):
    rows = spark.createDataFrame([("ast", None), ("llm", 1.7), ("llm", None), ("llm", float("nan")), ("hybrid", 0.4), ("hybrid", 0.5), ("x", 0.9)], "k string, s double")
    c, s = graph.tagged(F.col("k"), F.col("s"))
    assert [tuple(r) for r in rows.select(c, s).collect()] == [("EXTRACTED", 1.0), ("INFERRED", 1.0), ("AMBIGUOUS", None), ("AMBIGUOUS", None), ("AMBIGUOUS", 0.4), ("INFERRED", 0.5), ("AMBIGUOUS", None)]


def test_review_score_floor(spark):
    rows = spark.createDataFrame([("f", "critical")] * 5 + [("g", "low"), ("h", None)], "file string, severity string")
    assert values(quality.score(rows, "file"), "file", "score", "recommendation") == [("f", 0, "request_changes"), ("g", 99, "approve"), ("h", 100, "approve")]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab \t"), max_size=30), max_size=40), st.integers(10, 80))
def test_line_windows_cover_every_line(lines, target):
    spans = extract.line_windows("\n".join(lines), target, target // 5)
    count = len("\n".join(lines).split("\n"))
    assert spans[0][0] == 0 and spans[-1][1] == count - 1
    for (a, b), (c, d) in zip(spans, spans[1:], strict=False):
        assert a <= b and a < c <= b + 1 and d > b


def test_indexing_rules(spark):
    paths = ["src/a.ts", "node_modules/x.js", "a/.git/x.py", "b/readme", "c.PY", None, "./d.go"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select(scan.should_index(F.col("p")).alias("i"))
    assert [r["i"] for r in rows.collect()] == [True, False, False, False, True, False, True]


def test_source_tree(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.ts").write_text("export const a = 1;\n")
    (tmp_path / "dist").mkdir()
    (tmp_path / "dist/b.js").write_text("x")
    (tmp_path / "src/big.py").write_text("#" * 3000)
    assert values(scan.source_tree(spark, str(tmp_path), 2000), "path", "language") == [("src/a.ts", "typescript")]


def test_percent_and_series(spark):
    rows = spark.createDataFrame([("2025-01-01",), ("2025-01-03",), (None,)], "day string").select(F.to_date("day").alias("day"))
    got = telemetry.series(rows, "day", F.count(F.lit(1)).alias("n")).orderBy("day").collect()
    assert [r["n"] for r in got] == [1, None, 1]
    assert telemetry.series(rows.limit(0), "day", F.count(F.lit(1)).alias("n")).count() == 0


def test_busy_keys_limit_zero(spark):
    rows = spark.createDataFrame([("a", "2025-01-01 00:00:00"), ("a", "2025-01-01 00:30:00")], "k string, t string").withColumn("t", F.to_timestamp("t"))
    assert telemetry.busy_keys(rows, "k", "t", 0, 3600).count() == 0
    assert telemetry.busy_keys(rows, "k", "t", 1, 3600).count() == 1


def test_engine_refuses_bad_arguments(spark, root):
    from tessera.engine import Engine, InvalidArgument

    engine = Engine(spark, root)
    for tool, arguments in (("nope", {}), ("find_symbol", {"name": " "}), ("graph_analysis", {"kind": "x"}), ("find_dependencies", {"target": "a", "direction": "y"})):
        with pytest.raises(InvalidArgument):
            engine.call(tool, **arguments)
    assert engine.call("graph_analysis", kind="hotspots").count() > 0
    assert engine.call("search_codebase", query="ledger quiver", top_k=50).count() <= 20


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["x", "y", None]), st.one_of(st.none(), st.floats(-1e6, 1e6), st.floats(0, 1))), max_size=50))
def test_interpolated_percentiles(spark, rows):
    """Against the definition, with fractions below one and the null key."""
    frame = spark.createDataFrame(rows, "k string, v double")
    got = {(r["key"], r["p"]): r["value"] for r in skew.key_interpolated(frame, "k", "v", (0.0, 0.25, 0.9, 1.0)).collect()}
    groups = defaultdict(list)
    for k, v in rows:
        if v is not None:
            groups[k].append(v)
    for k, values_of in groups.items():
        ordered = sorted(values_of)
        for p in (0.0, 0.25, 0.9, 1.0):
            place = p * (len(ordered) - 1)
            low = int(place)
            want = ordered[low] + (place - low) * (ordered[min(low + 1, len(ordered) - 1)] - ordered[low])
            assert got[k, p] == pytest.approx(want, rel=1e-9, abs=1e-9)
    assert len(got) == 4 * len(groups)


def test_small_values_keep_their_buckets_apart(spark):
    frame = spark.createDataFrame([(v,) for v in (0.0, -0.5, 0.001, 0.25, 0.26, 0.5, 0.999, 1.0, 5e-324, float("inf"), -3.0)], "v double")
    rows = frame.select("v", skew._bucket(F.col("v")).alias("b")).orderBy("v").collect()
    assert [r["b"] for r in rows] == sorted(r["b"] for r in rows) and len({r["b"] for r in rows}) == len(rows)


def test_look_back_over_stretches(spark):
    times = [0, 10, 3599, 3600, 3601, 7300, 10900, 10900]
    rows = spark.createDataFrame([("a", t) for t in times] + [("b", 0), (None, 5)], "k string, s long").withColumn("t", F.timestamp_seconds("s"))
    got = sorted(r["recent"] for r in telemetry.busy_keys(rows, "k", "t", 1, 3600).where("k = 'a'").collect())
    assert got == sorted(n for n in (sum(t - 3600 <= o < t for o in times) for t in times) if n >= 1)


def test_formats_for_people(spark):
    sizes = spark.createDataFrame([(0,), (1023,), (1536,), (1 << 20,), (3 << 30,), (None,)], "n long").select(X.human_size(F.col("n")).alias("s"))
    assert [r["s"] for r in sizes.collect()] == ["0 B", "1023 B", "1.5 KB", "1.0 MB", "3.00 GB", None]
    ages = spark.createDataFrame([(5.0,), (61.0,), (7200.0,), (86400.0 * 3,), (86400.0 * 65,), (86400.0 * 800,), (-1.0,), (None,), (float("nan"),)], "n double").select(X.human_age(F.col("n")).alias("s"))
    assert [r["s"] for r in ages.collect()] == ["just now", "1m ago", "2h ago", "3d ago", "2mo ago", "2y ago", "unknown", "unknown", "unknown"]
    texts = spark.createDataFrame([("abcdef",), ("abc",), (None,), ("",)], "t string").select(X.ellipsis(F.col("t"), 4).alias("e"), X.truncated(F.col("t"), 5, "[..]").alias("c"))
    assert [tuple(r) for r in texts.collect()] == [("abc…", "a[..]"), ("abc", "abc"), (None, None), ("", "")]
    ranges = spark.createDataFrame([("24h",), ("30d",), ("0d",), ("999d",), ("x",), (None,)], "t string").select(X.range_days(F.col("t")).alias("d"))
    assert [r["d"] for r in ranges.collect()] == [1, 30, 7, 7, 7, 7]
    answers = spark.createDataFrame([('{"a": 1}',), ('so:\n```json\n{"a": 2}\n```',), ('it is {"a": 3} then',), ("none",), (None,)], "t string").select(F.get_json_object(X.tolerant_json(F.col("t")), "$.a").alias("a"))
    assert [r["a"] for r in answers.collect()] == ["1", "2", "3", None, None]
    words = spark.createDataFrame([("critical",), ("Warning",), ("suggestion",), ("info",), (None,)], "t string").select(X.severity(F.col("t")).alias("s"))
    assert [r["s"] for r in words.collect()] == ["critical", "high", "medium", "low", "low"]


def test_roles_and_artifacts(spark):
    rows = spark.createDataFrame([("a/b.guard.ts", []), ("x/user.service.ts", ["Injectable"]), ("x/user.ts", ["Controller"]), ("x/user.ts", None), (None, [])], "p string, d array<string>")
    assert [r["r"] for r in rows.select(scan.nest_role(F.col("p"), F.col("d")).alias("r")).collect()] == ["guard", "service", "controller", "unknown", "unknown"]
    paths = spark.createDataFrame([(p,) for p in ("db/a.sql", "x/schema.ts", "k8s/a.yaml", "main.tf", "docs/x/a.txt", "a/docs/b.txt", "README.md", "test/a.sql", "a.proto", "b.ts", None)], "p string")
    assert [r["k"] for r in paths.select(scan.artifact_kind(F.col("p")).alias("k")).collect()] == ["schema", "schema", "openapi", "terraform", None, "markdown", "markdown", None, "proto", None, None]
    pages = spark.createDataFrame([("app/page.tsx",), ("app/api/x/route.ts",), ("src/hooks/a.ts",), ("b.ts",)], "p string")
    assert [r["r"] for r in pages.select(scan.framework_role(F.col("p"), "nextjs").alias("r")).collect()] == ["page", "api-route", "hook", "component"]
    assert [r["r"] for r in pages.select(scan.framework_role(F.col("p"), "nestjs").alias("r")).collect()] == [None] * 4


def test_smells_at_their_thresholds(spark):
    chunks = spark.createDataFrame([("f", 400, None, False), ("g", 401, [("a",)], True), ("h", None, [(str(k),) for k in range(11)], False)], "file_id string, line_end int, imports array<struct<source: string>>, deep boolean")
    spans = spark.createDataFrame([("f", "run", "function", 1, 81), ("f", "go", "function", 1, 82), ("f", "A", "class", 1, 501), ("f", "B", "class", 1, 502), ("f", None, "class", None, None)], "file_id string, name string, kind string, first int, last int")
    methods = spark.createDataFrame([("f", f"A.m{k}") for k in range(15)] + [("f", f"B.m{k}") for k in range(16)], "file_id string, qualified string")
    got = values(quality.smells(chunks, spans, methods), "rule", "subject")
    assert got == [("deep_nesting", "g"), ("fan_out", "h"), ("god_class", "f:B"), ("large_file", "g"), ("long_function", "f:go"), ("many_methods", "f:B")]


def test_a_cluster_needs_a_shared_folder():
    from unittest.mock import MagicMock

    from tessera.session import ensure_checkpoint_dir

    session = MagicMock()
    session.sparkContext._jsc.sc().getCheckpointDir().isDefined.return_value = False
    session.conf.get.return_value = None
    session.sparkContext.master = "spark://head:7077"
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(session)
    session.conf.get.return_value = "hdfs:///shared"
    ensure_checkpoint_dir(session)
    session.sparkContext.setCheckpointDir.assert_called_with("hdfs:///shared")


def test_tools_check_their_parameters(spark, root):
    from tessera.engine import Engine, InvalidArgument

    engine = Engine(spark, root)
    for tool, arguments in (("search_code", {}), ("find_symbol", {"name": 3}), ("find_symbol", {"name": "a", "other": 1}), ("graph_analysis", {"kind": "nope"}), ("query_code_graph", {"file": ""})):
        with pytest.raises(InvalidArgument):
            engine.call(tool, **arguments)
    assert engine.call("get_api_endpoints").columns == ["chunk_id", "file_path", "line_no", "verb", "path", "handler"]
    engine.call("query_code_graph", file="nothing.ts").count()
    assert [h[0] for h in engine.history] == ["get_api_endpoints", "query_code_graph"]


def test_frameworks_by_priority(spark):
    paths = [("n", "package.json"), ("n", "next.config.js"), ("x", "web/next.config.ts"), ("deep", "a/b/next.config.ts"), ("v", "vite.config.ts"), ("r", "vite.config.js"), ("f", "requirements.txt"), ("s", "pom.xml"), ("e", "package.json"), (None, "a.ts")]
    texts = [("n", "package.json", '{"@nestjs/core": 1}'), ("v", "vite.config.ts", "import vue from '@vitejs/plugin-vue'"), ("r", "vite.config.js", "x"), ("f", "requirements.txt", "fastapi==1"), ("s", "pom.xml", "spring-boot"), ("e", "package.json", '{"express": 1}'), ("deep", "package.json", None)]
    got = scan.detected_framework(spark.createDataFrame(paths, "r string, file_path string"), spark.createDataFrame(texts, "r string, file_path string, text string"), "r")
    assert {r["r"]: r["framework"] for r in got.collect()} == {"n": "nestjs", "x": "nextjs", "deep": "unknown", "v": "vite-vue", "r": "vite-react", "f": "fastapi", "s": "spring", "e": "express", None: "unknown"}
