"""Vectors, hand-written files, percentiles, credentials and syntax against brute force and held-out data."""

import ast
import json

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import credentials as C
from tessera.llm import handwritten as H
from tessera.llm import quantiles as Q
from tessera.llm import similar as S
from tessera.llm import syntax as Y
from tessera.sources.files import file_texts


def brute(vectors, k):
    x = np.array(list(vectors.values()), dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T
    np.fill_diagonal(near, -2)
    names = list(vectors)
    return {(names[i], names[j]) for i in range(len(names)) for j in np.argsort(-near[i])[:k]}


def test_similar_against_brute_force(spark):
    random = np.random.default_rng(5)
    centres = random.normal(size=(12, 16))
    vectors = {f"v{k:04d}": (centres[k % 5 if k % 3 else k % 12] + 0.4 * random.normal(size=16)).tolist() for k in range(1500)}
    frame = spark.createDataFrame([(k, v) for k, v in vectors.items()], "id string, e array<float>")
    got = {(r["id"], r["neighbour"]) for r in S.similar(frame, "id", "e", k=5, width=16).collect()}
    want = brute(vectors, 5)
    assert len(got & want) / len(want) >= 0.9


def test_similar_with_copies_and_dirt(spark):
    same, other = [1.0, 0.0, 0.0, 0.5], [0.0, 1.0, 0.2, 0.0]
    rows = [(f"c{k:03d}", same) for k in range(300)] + [("a", other), ("b", [0.0, 2.0, 0.4, 0.1]), ("d", [0.9, 0.0, 0.1, 0.5])]
    rows += [("n", None), ("z", [0.0] * 4), ("s", [1.0]), ("x", [float("nan"), 1.0, 1.0, 1.0]), ("i", [float("inf"), 1.0, 1.0, 1.0]), ("a", other), (None, same)]
    frame = spark.createDataFrame([(a, b, "clash", 1) for a, b in rows], "chunk string, e array<float>, rep string, size int")
    got = S.similar(frame, "chunk", "e", k=3, width=4).toPandas()
    assert not set(got["id"]) & {"n", "z", "s", "x", "i", None}
    by = got.groupby("id")["neighbour"].apply(set)
    assert by["c000"] == {"c001", "c002", "c003"} and by["c299"] == {"c000", "c001", "c002"}
    assert "b" in by["a"] and "a" in by["b"]
    assert len(by["d"]) == 3 and all(x.startswith("c") for x in by["d"])
    assert (got.groupby("id").size() == 3).all()
    assert S.similar(frame.limit(0), "chunk", "e", k=3, width=4).count() == 0
    assert S.similar(frame.where("chunk = 'b'"), "chunk", "e", k=3, width=4).count() == 0


@settings(max_examples=25, deadline=None)
@given(seed=st.integers(0, 10**6), n=st.integers(1, 60_000), parts=st.integers(1, 9))
def test_sketch_rank_error_is_within_its_bound(seed, n, parts):
    random = np.random.default_rng(seed)
    values = random.choice([random.normal(size=n), random.integers(0, 5, n).astype(float), np.exp(random.normal(size=n) * 5)])
    total = Q.Sketch()
    for part in np.array_split(values, parts):
        sketch = Q.Sketch()
        sketch.add(part)
        total.merge(sketch)
    ordered = np.sort(values)
    assert total.n == n and total.bound / n <= 0.01
    for p, value in zip((0.01, 0.25, 0.5, 0.9, 0.99), total.at((0.01, 0.25, 0.5, 0.9, 0.99)), strict=True):
        rank = max(1, int(np.ceil(p * n)))
        low, high = np.searchsorted(ordered, value, "left") + 1, np.searchsorted(ordered, value, "right")
        assert low - total.bound - 1 <= rank <= high + total.bound + 1
    assert total.at((0.0, 1.0)) == [ordered[0], ordered[-1]]


def test_percentiles_of_dirty_groups(spark):
    rows = [("a", "d1", k) for k in range(101)] + [("a", "d2", None), (None, "d1", 5), ("b", None, 2**31 - 1), ("c", "d1", None)]
    frame = spark.createDataFrame(rows, "g string, day string, v int").withColumn("key", F.lit("clash"))
    got = {(r["key"], r["period"], r["p"]): (r["n"], r["value"], r["rank_error"]) for r in Q.percentiles(Q.merged(Q.sketches(frame, ["g"], ["v"], "day")), (0.5, 1.0)).collect()}
    assert got[("a", "d1", 0.5)] == (101, 50.0, 0.0)
    assert got[(None, "d1", 0.5)][1] == 5 and got[("b", None, 1.0)][1] == 2**31 - 1
    assert ("c", "d1", 0.5) not in got and ("a", "d2", 0.5) not in got
    assert Q.merged(Q.sketches(frame.limit(0), ["g"], ["v"], "day")).count() == 0


def test_hot_groups_and_weeks_of_every_kind(spark, tmp_path):
    random = np.random.default_rng(7)
    values = random.integers(0, 10**6, 20_000)
    frame = pd.DataFrame({"request_id": [f"q{k}" for k in range(20_000)], "source": "s", "model": "m", "repo_id": "r", "created_at": pd.to_datetime(["2024-05-06", "2024-05-06", "2024-05-08"] * 6666 + ["2024-05-06"] * 2, utc=True), "duration_ms": values, "total_tokens": 1})
    frame.to_parquet(f"{tmp_path}/ai_request_metrics.parquet", coerce_timestamps="us")
    days = frame["created_at"].dt.strftime("%Y-%m-%d")
    from tessera.llm.queries import QUERIES

    for name, keys in (("p3_days", days), ("p3_weeks", pd.Series(["2024-05-06"] * 20_000))):
        got = [r for r in QUERIES[name](spark, str(tmp_path)).collect() if r["metric"] == "duration_ms"]
        assert {(r["dim"], r["period"]) for r in got} == {(d, p) for d in ("source", "model", "repo_id", "all") for p in set(keys)}
        for r in got:
            ordered = np.sort(values[(keys == r["period"]).to_numpy()])
            rank, off = max(1, int(np.ceil(r["p"] * len(ordered)))), r["rank_error"] * len(ordered) + 1
            assert r["n"] == len(ordered)
            assert np.searchsorted(ordered, r["value"], "left") + 1 - off <= rank <= np.searchsorted(ordered, r["value"], "right") + off


CODE = {
    "a.py": ("def f(a):\n    return {'x': [1, (2)]}\n", "def f(a)\n    return a\n"),
    "b.json": ('{"a": [1, 2.5e3, "\\u00e9", null]}', '{"a": 1,}'),
    "c.js": ("const re = /[/]x/g; const t = `a ${b ? `c${1}` : {d: 2}.d} e`;\nif (a) { x: for (;;) break x }\n", "function f(a: number) { return a }"),
    "d.ts": ("export class A<T> { private x?: Map<string, T> = new Map(); get(k: string): T | undefined { return this.x!.get(k); } }", "export class A { f() { return 'x; }\n}"),
    "e.go": ("package a\n\nimport \"fmt\"\n\ntype T struct {\n\tA int `json:\"a\"`\n}\n\nfunc (t *T) F(x []int) (int, error) {\n\tfor i := range x[1:] {\n\t\tfmt.Println(i)\n\t}\n\treturn 0, nil\n}\n", "package a\n\nfunc f() {\n"),
    "f.java": ("package a;\nimport java.util.*;\npublic class A<T extends B> {\n  @Override public int f(int a) throws X { switch (a) { case 1: return a > 0 ? 1 : 2; default: } for (int b : c) { d(b); } return 0; }\n}\n", "public class A { void f() { g(1)\n h(2); } }"),
    "g.mjs": ("import x from './y';\nexport default () => x;\n", "<<<<<<< HEAD\nexport {};\n=======\n>>>>>>> other\n"),
}


@pytest.mark.parametrize("path", CODE)
def test_valid_and_invalid_code(path):
    good, bad = CODE[path]
    assert Y.fault_of(path, good) is None
    assert Y.fault_of(path, "﻿" + good.replace("\n", "\r\n")) is None
    assert Y.fault_of(path, bad) is not None


@pytest.mark.parametrize("path", ["a.py", "c.js", "d.ts", "e.go", "f.java"])
def test_empty_and_comments_are_valid(path):
    note = "# x\n" if path.endswith(".py") else "// x\n/* y */\n"
    for text in ("", note, None):
        assert (Y.fault_of(path, text) is None) or path == "e.go" and text
    assert Y.fault_of(path.replace(path.split(".")[1], "json"), "") is not None


@settings(max_examples=150, deadline=None)
@given(st.recursive(st.one_of(st.none(), st.booleans(), st.integers(), st.text(max_size=5), st.floats(allow_nan=False, allow_infinity=False)), lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(st.text(max_size=3), x, max_size=3)), max_leaves=8), st.integers(0, 200))
def test_json_agrees_with_the_parser(value, cut):
    text = json.dumps(value, ensure_ascii=False)
    for candidate in (text, text[: cut % (len(text) + 1)], text + "]"):
        try:
            json.loads(candidate)
            valid = True
        except ValueError:
            valid = False
        assert (Y.fault_of("x.json", candidate) is None) == valid


def test_faults_of_real_python_files(spark, root):
    files = file_texts(spark, root).where("file_path LIKE '%.py'").toPandas()
    for path, text in zip(files["file_path"], files["text"], strict=True):
        try:
            ast.parse(text.removeprefix("﻿"))
            valid = True
        except (SyntaxError, ValueError):
            valid = False
        assert (Y.fault_of(path, text) is None) == valid


def test_statement_rules_of_python_raise_no_false_alarm():
    """Modules of the standard library, which are valid, and lines that are not."""
    import glob
    import sysconfig

    for path in glob.glob(f"{sysconfig.get_paths()['stdlib']}/*.py"):
        with open(path, encoding="utf-8", errors="strict") as file:
            try:
                text = file.read()
                ast.parse(text)
            except (SyntaxError, ValueError):
                continue
        Y._statements(text)
    for bad in ("for x in y:\nz\n", "if x\n    y\n", "def f(a: int)\n    pass\n", "x = 1\n  y = 2\n", "// note\n", "404: Not Found\n", "a = “b”\n", "if a:\n        b\n    c\n", "import a b\n", "try:\n    pass\nexcept:\n", "@@ -1,2 +1,2 @@\n"):
        with pytest.raises(Y._Fault):
            Y._statements(bad)


def test_rates_with_nulls(spark):
    frame = spark.createDataFrame([("1", "a.json", "{}", None), ("2", "b.json", "{", None), ("3", "c.md", "{", "r"), ("4", None, None, "r"), ("5", "d.py", None, "r")], "file_id string, file_path string, text string, repo_id string")
    checked = Y.parse_faults(frame)
    assert {r["file_id"]: r["valid"] for r in checked.collect()} == {"1": True, "2": False, "3": None, "4": None, "5": True}
    assert {r["repo_id"]: (r["n_files"], r["invalid_rate"]) for r in Y.fault_rates(checked, "repo_id").collect()} == {None: (2, 0.5), "r": (1, 0.0)}
    assert Y.parse_faults(frame.limit(0)).count() == 0


@pytest.fixture(scope="module")
def corpus(spark):
    return file_texts(spark, "/root/testdata/sf0.01", "repo_id").toPandas().sort_values("file_id")


@pytest.fixture(scope="module")
def field(corpus):
    return C.fit_field(C.training_lines(list(corpus["text"])))


def test_field_finds_held_out_secrets(corpus):
    """Trained on two thirds of the files: recall and precision against the labelling rules on the rest."""
    texts = list(corpus["text"])
    field = C.fit_field(C.training_lines([t for k, t in enumerate(texts) if k % 3]))
    right = said = truth = 0
    for text in texts[::3]:
        found = {i for i, _, _ in C.secrets_of(field, text)}
        rules = {i for i, line in enumerate(text.split("\n")) if C.rule_spans(line)}
        right, said, truth = right + len(found & rules), said + len(found), truth + len(rules)
    assert right / truth >= 0.8 and right / said >= 0.9


def test_redaction_keeps_the_rest(spark, field):
    token = "ghp_" + "aB3dE5gH7jK9mN1pQ3sT5vW7yZ9bC2dF4hJ6"
    text = f"const a = 1;\r\nconst apiToken = '{token}';\nconst b = \"x\";"
    frame = spark.createDataFrame([("k", text, 5, "x"), ("n", None, 1, "x"), ("e", "", None, "x"), ("p", 'password: "changeme"', 1, "x")], "id string, t string, line int, redacted string")
    got = {r["id"]: (r["redacted"], r["n_secrets"]) for r in C.redacted(frame, "id", "t", field).collect()}
    assert got["k"] == (text.replace(token, C.MARK), 1)
    assert got["n"] == (None, 0) and got["e"] == ("", 0) and got["p"][1] == 0
    assert [(r["id"], r["line_no"]) for r in C.found_secrets(frame, "id", "t", "line", field).collect()] == [("k", 6)]


def test_private_keys_are_redacted_whole(field):
    key = "-----BEGIN PRIVATE KEY-----\nMIIabc\nDEFghi=\n-----END PRIVATE KEY-----"
    text = f"const tlsKey = `{key}`;\nnext()"
    spans = C.secrets_of(field, text)
    assert len(spans) == 1 and text[spans[0][1] : spans[0][2]] == key


def test_private_keys_go_on_in_the_next_chunks(spark, field):
    body = ["MIIabc" + "aB3d" * 14, "Q1+/" * 16, "x9Yz" * 15]
    rows = [("a1", "A", 1, f"const tlsKey = `-----BEGIN PRIVATE KEY-----\n{body[0]}"), ("a2", "A", 3, f"{body[1]}\n"), ("a3", "A", 5, f"{body[2]}\nDE=\n-----END PRIVATE KEY-----`;\nnext()"), ("a4", "A", 9, body[0])]
    rows += [("b1", "B", 1, rows[0][3].replace("\n", '\\n" +\n"')), ("b2", "B", 3, f'  "{body[1]}\\n"\n  + "-----END PRIVATE KEY-----";\nrun()')]
    rows += [("c1", "C", 1, 'if (text.startsWith("-----BEGIN PRIVATE KEY-----")) {'), ("c2", "C", 2, "return"), ("n1", None, 1, rows[0][3]), ("n2", None, 3, body[1]), ("d1", "D", 1, None), ("d2", "D", 2, body[1])]
    frame = spark.createDataFrame(rows + rows[:3], "id string, f string, line int, t string")
    got = {r["id"]: r["redacted"] for r in C.redacted(frame, "id", "t", field, "f", "line").collect()}
    assert got["a2"] == C.MARK + "\n" and got["a3"] == f"{C.MARK}`;\nnext()" and got["b2"].endswith('";\nrun()')
    assert not any(part in (got[k] or "") for k in got if k < "c" and k != "a4" for part in body)
    assert not {"a4", "c2", "n2", "d1", "d2"} & set(got)
    lines = {(r["id"], r["line_no"]) for r in C.found_secrets(frame, "id", "t", "line", field, "f").collect()}
    assert ("a1", 1) in lines and not {k for k, _ in lines} & {"a2", "a3", "a4", "b2", "c2", "n2"}


def test_field_finds_planted_secrets_of_unseen_places(field):
    """Ways of writing that the training never saw, in real files: every planted secret is found, harmless values are not."""
    places = ("{n} <- '{v}'|put(\"{n}\", \"{v}\");|  - {n}: '{v}'|setenv {n} {v}|$ {n}={v} make|{n}: {{ value: \"{v}\" }}|//   {n} = {v}", "assertEquals({w}, \"{v}\")|ftp {w} {w}:{v}", "{w}: amqp://{w}:{v}@{w}.example|GET https://{w}.example/?token={t}")
    hits = missed = wrong = harmless = 0
    lines = C.planted(600, seed=99, places=places)
    for line, secrets in lines:
        found = C.secrets_of(field, line)
        if secrets:
            hits, missed = hits + bool(found), missed + (not found)
            assert not found or any(a < e and s < b for _, a, b in found for s, e in secrets)
        else:
            harmless, wrong = harmless + 1, wrong + bool(found)
    assert hits / (hits + missed) >= 0.95 and wrong / harmless <= 0.05


def test_no_character_of_a_key_stays_over_chunk_borders(spark, field):
    """All private keys of the larger table that run on into another chunk."""
    chunks = spark.read.parquet("/root/testdata/sf0.1/code_chunks.parquet").select("chunk_id", "file_id", "line_start", "content").dropDuplicates(["chunk_id"])
    open_key = F.col("content").rlike("-----BEGIN [A-Z ]*PRIVATE KEY-----") & ~F.col("content").rlike("-----END [A-Z ]*PRIVATE KEY-----")
    files = [r["file_id"] for r in chunks.where(open_key).select("file_id").distinct().collect()]
    part = chunks.where(F.col("file_id").isin(files))
    got = {r["chunk_id"]: r["redacted"] for r in C.redacted(part, "chunk_id", "content", field, "file_id", "line_start").collect()}
    rows = part.orderBy("file_id", "line_start").collect()
    crossing = 0
    for before, after in zip(rows, rows[1:], strict=False):
        if before["file_id"] == after["file_id"] and "PRIVATE KEY-----" in after["content"].split("-----END")[-1] and "-----BEGIN" not in after["content"].split("-----END")[0]:
            crossing += 1
            body = after["content"].split("-----END")[0]
            left = got[after["chunk_id"]]
            assert not any(run in left for run in C._MATERIAL.findall(body)) and "-----END" not in left.split("\n")[0]
    assert crossing >= 5


def test_what_no_word_list_gates_is_read(field):
    for line in ("curl -u admin:Tr0ub4dor-Blue9 https://x.example", "mysql -u app -pS3cret-Blue77 db", "# login with hunter2Blue!", "if (given == 'Rose-Valley4711!') {"):
        assert C.secrets_of(field, line), line
    begin = "-----BEGIN PRIVATE KEY-----"
    text = f"if (text.startsWith('{begin}')) {{\n  const password = 'Falcon.Copper9370!';\n}}"
    assert any("Falcon" in text[a:b] for _, a, b in C.secrets_of(field, text)) and "}" in text[C.secrets_of(field, text)[-1][2] :]


def test_field_without_lines_finds_nothing(spark):
    frame = spark.createDataFrame([], "id string, t string")
    field = C.train_field(frame, "id", "t")
    assert C.secrets_of(field, "password = 'aB3dE5gH7jK9'") == []


def test_classifier_on_held_out_repositories(corpus):
    sample = corpus.assign(shared=0, body="")[["file_path", "text", "repo_id", "shared", "body"]]
    model = H.train(sample)
    assert model.quality["accuracy"] >= 0.9


def test_giveaways_and_masks():
    assert H.gives_away("a/vendor/b.go", "package b") and not H.gives_away("a/vendors/b.go", "package b")
    text = "// Code generated by x. DO NOT EDIT.\nclass A {}\n"
    assert H.gives_away("a.js", text) and not H.gives_away("a.js", H.masked(text))
    assert not H.gives_away("src/generator/a.py", "banner = 'Code generated by our template'\n")


def test_scores_of_dirty_files(spark):
    rows = [(f"{k}", "r1" if k % 2 else "r2", f"src/f{k}.js", f"const a{k} = require('./b{k}');\nfunction run{k}(x) {{\n  return x + {k};\n}}\n") for k in range(30)]
    rows += [(f"g{k}", "r1", f"gen/g{k}.pb.js", "// @generated by tool\n" + "".join(f"getA{j}() {{ return this.f[{j}]; }}\n" for j in range(20))) for k in range(10)]
    rows += [("n", None, None, None), ("e", "r1", "a/e.js", "")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "file_id string, repo_id string, file_path string, text string, score int")
    scores, _ = H.scored(frame)
    got = {r["file_id"]: r["score"] > 0 for r in scores.collect()}
    assert len(got) == len(rows)
    assert all(got[f"g{k}"] for k in range(10)) and not any(got[f"{k}"] for k in range(30))
    assert H.scored(frame.limit(0))[0].count() == 0


def test_features_are_finite():
    for path, text in (("", ""), ("a", "x"), ("a/b.c", "é" * 10), ("x" * 500, "\n" * 1000)):
        buckets, values = H.features(path, text)
        assert len(buckets) == len(values) and np.isfinite(values).all()
    assert isinstance(pd.DataFrame(), pd.DataFrame)


@settings(max_examples=30, deadline=None)
@given(seed=st.integers(0, 10**6), n=st.integers(1, 40))
def test_footrule_ranks_as_the_sum_of_differences(seed, n):
    """Against the definition: places of both orders over all their pivots, missing ones behind the end."""
    random = np.random.default_rng(seed)
    depth = S.ORDER
    orders = np.array([random.permutation(40)[:depth] for _ in range(n + 1)], dtype=np.int32)
    got = S.footrule(orders[:1], orders[1:])[0].astype(int)
    place = [{p: j for j, p in enumerate(o)} for o in orders.tolist()]
    want = [sum(abs(place[0].get(p, depth) - other.get(p, depth)) for p in {*place[0], *other}) for other in place[1:]]
    assert len({g * 2 - w for g, w in zip(got, want, strict=True)}) == 1


def test_cosines_of_a_vector_are_bounded_and_recall_holds(spark):
    """All vectors of a table in the index; candidates don't grow with the files."""
    assert sum(S.CANDIDATES) < 1000
    rows = spark.read.parquet("/root/testdata/sf0.01/code_chunks.parquet").select("chunk_id", "embedding").dropDuplicates(["chunk_id"])
    got = {(r["id"], r["neighbour"]) for r in S.similar(rows, "chunk_id", "embedding").collect()}
    kept = {r["chunk_id"]: r["embedding"] for r in rows.collect() if r["embedding"] and len(r["embedding"]) == 64 and np.isfinite(r["embedding"]).all() and any(r["embedding"])}
    want = brute(kept, 5)
    assert {a for a, _ in got} == set(kept)
    assert len(got & want) / len(want) >= 0.95


def test_models_are_fitted_once(spark, tmp_path):
    from tessera.llm import models

    fitted = []
    fit = lambda: fitted.append(1) or {"weights": np.arange(3)}
    assert models.kept(spark, "m", fit)["weights"].tolist() == [0, 1, 2] and len(fitted) == 1
    spark.conf.set(models.SETTING, str(tmp_path))
    try:
        for _ in range(3):
            assert models.kept(spark, "m", fit)["weights"].tolist() == [0, 1, 2]
        assert len(fitted) == 2
    finally:
        spark.conf.unset(models.SETTING)
