"""Operators on small hand-made rows."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from coverloom.functions import text as T
from coverloom.functions.globs import glob_regex
from coverloom.operators import evidence, findings, graph, matching, merge, rollups, verify, windows


@pytest.mark.parametrize(
    ("glob", "path", "hit"),
    [("a/*.go", "a/b.go", True), ("a/*.go", "a/b/c.go", False), ("**/*.md", "x.md", True), ("**/*.md", "a/b/x.md", True), ("a/**", "a", True), ("a/**", "a/b/c", True), ("a?[bc].x", "azb.x", True), ("a?[bc].x", "a/b.x", False), ("./a/*", "a/b", True), ("a/**/z", "a/z", True), ("a/**/z", "a/b/c/z", True)],
)
def test_globs(glob, path, hit):
    assert bool(re.match(glob_regex(glob), path)) is hit


def test_scalars(spark):
    rows = spark.createDataFrame([("HTTPServerName", "class")], "a string, b string")
    got = rows.select(T.split_camel(F.col("a")), T.stems(F.array("b", F.lit("run"), F.lit("item"))), T.percent(F.lit(1), F.lit(3)), T.percent(F.lit(5), F.lit(0)), T.removed_at(F.lit("NEXT"), "HEAD"), T.removed_at(F.lit("12"), "20"), T.distinctive_token(F.lit("grpc.channelz.v1"))).first()
    assert list(got) == [["http", "server", "name"], ["class", "run", "item", "items"], 33, 0, False, True, "channelz"]


ELEMENTS = "id string, kind string, library string, aliases array<string>"


@pytest.fixture(scope="module")
def elements(spark):
    return spark.createDataFrame([("lib/P.Open", "METHOD", "lib", ["lib.P.Open"]), ("lib/Q.Open", "METHOD", "lib", []), ("lib/Q", "TYPE", "lib", []), ("oth/P.Open", "METHOD", "oth", [])], ELEMENTS)


def test_doc_references(spark, elements):
    refs = spark.createDataFrame([("a", "lib/P.Open"), ("b", "P.Open"), ("c", "lib.P.Open"), ("d", "Nope")], "owner string, ref string")
    got = {(r.owner, r.element_id) for r in matching.doc_matches(refs, elements).collect()}
    assert got == {("a", "lib/P.Open"), ("b", "lib/P.Open"), ("b", "oth/P.Open"), ("c", "lib/P.Open")}


def test_inherited_reference(spark, elements):
    refs = spark.createDataFrame([("a", "lib/P.Open")], "owner string, ref string")
    edges = spark.createDataFrame([("lib/Q.Open", "INHERITED_FROM", "lib/P.Open")], "src_id string, kind string, target_id string")
    assert {r.element_id for r in matching.doc_matches(refs, elements, edges).collect()} == {"lib/P.Open", "lib/Q.Open"}


def test_wildcards_stay_in_their_library(spark, elements):
    refs = spark.createDataFrame([("t", "lib/*.Open")], "owner string, ref string")
    assert {r.element_id for r in matching.test_matches(refs, elements).collect()} == {"lib/P.Open", "lib/Q.Open"}


@pytest.mark.parametrize(
    ("element", "path", "names", "hit"),
    [
        ("docker container run", "cli/command/container/run_test.go", ["run"], True),
        ("docker run", "cli/command/container/commit_test.go", ["run", "commit"], False),
        ("kubectl cluster-info", "pkg/cmd/clusterinfo/clusterinfo_test.go", [], True),
        ("ffx component show", "src/component/show/src/lib.rs", [], True),
        ("ffx component show", "src/component/list/src/lib.rs", ["show"], False),
        ("kubectl", "pkg/kubectl_test.go", ["kubectl"], False),
    ],
)
def test_command_names(spark, element, path, names, hit):
    els = spark.createDataFrame([(element, "SUBCOMMAND", element.split(" ")[0], [])], ELEMENTS)
    tests = spark.createDataFrame([("t", path, names)], "test_id string, path string, name_tokens array<string>")
    assert (matching.cli_matches(tests, els).count() == 1) is hit


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_command_names_judge_a_case_once_without_broadcasts(spark):
    # rows whose size Spark knows, and takes for small
    els = spark.sql("SELECT 'ffx component show' AS id, 'SUBCOMMAND' AS kind, 'ffx' AS library, CAST(array() AS array<string>) AS aliases")
    tests = spark.sql("SELECT *, array('show') AS name_tokens FROM VALUES ('a', 'src/component/show/src/lib.rs'), ('b', 'src/component/show/src/lib.rs'), ('c', 'src/component/list/src/lib.rs') AS t(test_id, path)")
    got = matching.cli_matches(tests, els)
    assert "Broadcast" not in _plan(got)
    assert sorted(r.test_id for r in got.collect()) == ["a", "b"]


def test_lags_of_rows_taken_for_small_join_without_broadcasts(spark):
    els = spark.sql("SELECT * FROM VALUES ('e', 'a.go', 1), ('f', 'b.go', 1) AS t(id, path, line)")
    refs = spark.sql("SELECT * FROM VALUES ('e', 'd.md', 3), ('g', 'd.md', 3) AS t(element_id, path, line)")
    times = spark.sql("SELECT * FROM VALUES ('a.go', 0, 259200L), ('d.md', 3, 86400L) AS t(path, line, ts)")
    got = rollups.lag_pairs(els, refs, times, times.select("path"))
    assert "Broadcast" not in _plan(got)
    assert [(r.element_id, r.inline, r.days) for r in got.collect()] == [("e", False, 2)]


def test_lags_write_their_times_once_before_four_joins_read_them(spark):
    els = spark.sql("SELECT * FROM VALUES ('e', 'a.go', 1), ('f', 'b.go', 1) AS t(id, path, line)")
    refs = spark.sql("SELECT * FROM VALUES ('e', 'd.md', 3), ('f', 'd.md', 4), ('f', 'n.md', 1) AS t(element_id, path, line)")
    times = spark.sql("SELECT * FROM VALUES ('a.go', 0, 259200L), ('b.go', 0, 259200L), ('d.md', 3, 0L), ('d.md', 3, 86400L), ('d.md', 0, 172800L), ('d.md', -1, 1L), ('n.md', 0, 1L) AS t(path, line, ts)")
    got = rollups.lag_pairs(els, refs, times, times.select("path").where("path <> 'n.md'"))
    assert _plan(got).count("SortMergeJoin") == 5  # a line's and a file's time of code and of text, and the two together
    assert sorted((r.element_id, r.path, r.days) for r in got.collect()) == [("e", "d.md", 2), ("f", "d.md", 1), ("f", "n.md", None)]


def test_documentation_counts_owners_once_without_their_pairs(spark):
    els = spark.sql("SELECT *, CAST(array() AS array<string>) AS aliases FROM VALUES ('lib/P.Open'), ('lib/Q.Open'), ('oth/P.Open') AS t(id)")
    edges = spark.sql("SELECT * FROM VALUES ('lib/Q.Open', 'INHERITED_FROM', 'lib/P.Open'), ('x', 'INHERITED_FROM', 'y') AS t(src_id, kind, target_id)")
    refs = spark.sql("SELECT * FROM VALUES ('a', 'P.Open'), ('a', 'lib/P.Open'), ('b', 'P.Open'), ('b', 'P.Open'), ('c', 'lib/Q.Open'), ('d', 'Nope'), ('e', NULL) AS t(owner, ref)")
    pairs = matching.doc_matches(refs, els, edges).groupBy("element_id").agg(F.count(F.lit(1)).alias("n"))
    got = {tuple(r) for r in matching.doc_match_counts(refs, els, edges).collect()}
    assert got == {tuple(r) for r in pairs.collect()} == {("lib/P.Open", 2), ("lib/Q.Open", 3), ("oth/P.Open", 2)}


def test_sections_and_categories(spark):
    rules = [{"dotted_path": "docs.tutorial", "paths": ["a/**"], "section_excludes": ["options"]}, {"dotted_path": "docs.concepts", "paths": ["a/b/**"]}]
    rows = spark.createDataFrame([("a/x.md", ["Options"]), ("a/b/x.md", ["Options"]), ("a/x.md", []), ("z", [])], "p string, s array<string>")
    got = [r[0] for r in rows.select(evidence.categories(F.col("p"), F.col("s"), rules)).collect()]
    assert got == [[evidence.SECTION_EXCLUDED], ["docs.concepts"], ["docs.tutorial"], []]


def test_proposed_rows_never_count(spark):
    kinds = spark.createDataFrame([("EXAMPLE", "LLM"), ("WORKFLOW", "LLM"), ("EXAMPLE", "DETERMINISTIC")], "kind string, tier string")
    got = [r[0] for r in kinds.select(evidence.doc_bucket(F.col("kind"), F.lit("md"), F.lit(""), F.col("tier"))).collect()]
    assert got == [None, None, "examples/in_docs"]
    assert kinds.select(evidence.test_bucket(F.lit("tests.e2e"), F.col("tier"))).first()[0] == "tests/llm_inferred"


def test_tier_precedence(spark):
    rows = spark.createDataFrame([("a", "LLM", 1), ("a", "DETERMINISTIC", 2), ("a", "DETERMINISTIC", 3), (None, "LLM", 1), ("", "LLM", 1)], "id string, tier string, n int")
    assert [(r.id, r.n) for r in merge.union_first(rows, "id", "n").collect()] == [("a", 2)]


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    assert graph.closure(edges).count() == 6


def test_components_and_macros(spark):
    nodes = spark.createDataFrame([(c,) for c in "abcdef"], "node string")
    edges = spark.createDataFrame([("f", "e"), ("e", "d"), ("b", "a")], "a string, b string")
    assert {r.node: r.root for r in graph.components(nodes, edges).collect()} == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "d", "f": "d"}
    macros = spark.createDataFrame([("A", "p", 1, "B(x)"), ("A", "p", 2, "C"), ("B", "p", 3, "1"), ("C", "p", 4, "2")], "name string, path string, line int, body string")
    assert [(r.name, r.target) for r in graph.macro_aliases(macros).collect()] == [("A", "B")]


def test_ground_truth(spark):
    got = spark.range(1).select(*(verify.ground_truth(F.lit(a), F.lit(b)) for a, b in ((100, 101), (100, 105), (100, 120)))).first()
    assert list(got) == ["clean", "warning", "error"]


def test_facade_edges_join_arrays_of_ids(spark, monkeypatch):
    monkeypatch.setattr(graph, "EDGE_BLOCK", 2)
    monkeypatch.setattr(graph, "BACKENDS_PER_TASK", 3)
    schema = "id string, path string, module string, local string"
    rows = [(f"b{i}", f"p{i % 3}", f"m{i % 2}", "hot" if i % 5 else f"n{i % 4}") for i in range(700)]
    backends = spark.createDataFrame([*rows, (None, "p0", "m0", "hot"), ("x", "p0", "m0", None), ("f1", "p0", "m0", "hot"), ("y", "p2", "m9", "hot"), ("b1", "p1", "m1", "hot")], schema)
    paths = spark.createDataFrame([("p0", "L0"), ("p0", "L1"), ("p1", "L1")], "path string, facade string")
    modules = spark.createDataFrame([("m0", "L0"), ("m1", "L2")], "module string, facade string")
    facades = spark.createDataFrame([*((f"f{i}", f"L{i % 3}", "hot" if i % 2 else f"n{i % 4}") for i in range(90)), (None, "L0", "hot"), ("g", None, "hot"), ("f1", "L1", "hot")], "id string, library string, local string")
    out = backends.join(paths, "path", "left").join(modules.withColumnRenamed("facade", "m"), "module", "left").withColumn("library", F.coalesce("facade", "m"))
    plain = out.join(facades.withColumnRenamed("id", "f"), ["library", "local"]).where("id <> f").select("id", "f")
    got = graph.facade_edges(backends, paths, modules, facades)
    assert "collect_list" in _plan(got)  # no row for each pair goes through a join
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def test_facade_edges_open_few_pairs_at_once(spark, monkeypatch):
    monkeypatch.setattr(graph, "EDGE_SLICE", 3)
    backends = spark.range(10).selectExpr("concat('b', id) AS id", "'p' AS path", "'m' AS module", "'x' AS local")
    paths, modules = spark.sql("SELECT 'p' AS path, 'L' AS facade"), spark.sql("SELECT 'm' AS module, 'M' AS facade")
    facades = spark.range(7).selectExpr("concat('f', id) AS id", "'L' AS library", "'x' AS local")
    got = graph.facade_edges(backends, paths, modules, facades)
    assert sorted(map(tuple, got.collect())) == sorted((f"b{i}", f"f{j}") for i in range(10) for j in range(7))
    # slices of sources are cut outside the compiled loop (*) that holds all pairs of its input row
    made = [x.strip(" :+-") for x in got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines() if "Generate explode(" in x]
    assert len(made) == 3 and [x.startswith("*") for x in made] == [True, True, False]


def test_lag_and_chips(spark):
    got = spark.range(1).select(rollups.lag_days(F.lit(200000), F.lit(86400)), rollups.lag_bucket(F.lit(40)), rollups.tier_sentence(F.lit(60))).first()
    assert list(got) == [1, "AGING", "high"]
    cells = [("concept", 10, 10, 0, 1, "cpp"), ("concept", 0, 10, 0, 1, "cpp"), ("test", 9, 10, 5, 1, "cpp"), ("test", 9, 10, 9, 1, "cpp"), ("example", 9, 10, 0, 0, "cpp"), ("example", 8, 10, 0, 3, "cpp"), ("implementations", 1, 10, 0, 1, "cpp"), ("concept", 1, 10, 0, 1, "fidl"), ("concept", 0, 0, 0, 1, "cpp")]
    rows = spark.createDataFrame(cells, "s string, n long, t long, i long, x long, e string")
    chip = rollups.confidence_chip(F.col("s"), F.col("n"), F.col("t"), F.col("i"), F.col("x"), F.lit(True), F.col("e"))
    assert [r[0] for r in rows.select(chip).collect()] == ["Verified", "Needs tuning", "Needs tuning", "Verified", "Not measured", "Verified", "Lower bound", None, None]


def test_affordance_names(spark):
    names = {"cml:rust/first_example/greeting": "greeting", "argh:make --arch": "arch", "argh:list --include-components": "include_components", "argh:server MAX_CONNECTIONS": "max_connections", "my.io/Directory.Open": "open", "x:y <fileName>": "file_name", "": ""}
    rows = spark.createDataFrame([(k,) for k in names], "id string")
    assert {r[0]: r[1] for r in rows.select("id", T.affordance_name(F.col("id"))).collect()} == names


def test_bridged_by_kind(spark):
    rows = spark.createDataFrame([("METHOD", True, False, True, True), ("METHOD", True, True, True, False), ("FLAG", True, True, True, False), ("CPP_CLASS", False, True, False, False), ("LIBRARY", True, False, True, False), ("OTHER", True, True, False, False)], "kind string, concept boolean, test boolean, example boolean, impl boolean")
    assert [r[0] for r in rows.select(rollups.bridged(F.col("kind"))).collect()] == [True, False, True, True, True, False]
    assert [r[0] for r in rows.select(rollups.bridged(F.col("kind"), ["test"])).collect()] == [True, True, True, True, True, True]


def test_finding_options(spark):
    profiles = spark.createDataFrame([("a", "METHOD", 1, False), ("b", "METHOD", 1, False)], "element_id string, kind string, tests long, has_any_doc boolean")
    els = spark.createDataFrame([("a", "x/a.c"), ("b", "y/b.c")], "id string, path string")
    known = findings.Corpus(els, profiles, profiles)
    got = findings.analyze(known, {"tested-undocumented": {"severity": "ERROR"}}, ["y/**"]).collect()
    assert [(r.subject, r.severity) for r in got] == [("a", "ERROR")]
    with pytest.raises(ValueError):
        findings.analyze(known, {"nope": {}})


def test_heading_stack(spark):
    rows = spark.createDataFrame([("d", 0, 1, "A"), ("d", 1, 2, "B"), ("d", 2, 4, "C"), ("d", 3, None, None), ("d", 4, 2, "D"), ("d", 5, 1, "E")], "doc string, off int, level int, title string")
    assert [r.section for r in windows.heading_stack(rows, "doc", "off").orderBy("off").collect()] == [["A"], ["A", "B"], ["A", "B", "C"], ["A", "B", "C"], ["A", "D"], ["E"]]


def test_stale_doc(spark):
    els = spark.createDataFrame([("a", "x.c"), ("b", "y.c")], "id string, path string")
    rows = spark.createDataFrame([("a", "reference.clidoc", "d.md", 1), ("b", "reference.clidoc", "y.c", 1)], "element_id string, bucket string, path string, line int")
    times = spark.createDataFrame([("x.c", 100 * 86400), ("y.c", 100 * 86400), ("d.md", 9 * 86400)], "path string, ts long")
    assert [r.subject for r in findings.stale_doc(els, rows, times).collect()] == ["a"]
