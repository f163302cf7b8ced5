"""Parsers on small texts, and the scan of a folder."""

from __future__ import annotations

import io
import json
import tarfile
import zipfile
from pathlib import Path

import pytest

from coverloom.sources import contracts as C
from coverloom.sources import docs as D
from coverloom.sources import files, registry
from coverloom.sources import tests as T


def ids(rows):
    return [r["id"] for r in rows]


def test_fidl():
    rows = list(C.fidl("a.fidl", "library my.io;\n/// Doc.\nopen protocol Dir {\n  compose Node;\n  /// Opens.\n  strict Open(struct { path Path; }) -> (struct { s Status; });\n};\ntype Path = string;"))
    assert ids(rows) == ["my.io/Dir", "my.io/Dir.Open", "my.io/Path"]
    assert rows[0]["edges"] == [{"kind": "COMPOSED_FROM", "target": "my.io/Node"}]
    assert rows[1]["doc"] == "Opens." and {"kind": "RETURNS", "target": "my.io/Status"} in rows[1]["edges"]


def test_proto():
    rows = list(C.proto("a.proto", "package a.v1;\nservice S {\n  // Gets.\n  rpc Get(Req) returns (stream Res);\n}\nmessage Req {}"))
    assert ids(rows) == ["a.v1/S", "a.v1/S.Get", "a.v1/Req"] and rows[1]["aliases"] == ["a.v1.S.Get"] and rows[1]["doc"] == "Gets."


def test_command_lines():
    pytest.importorskip("yaml")
    rows = list(C.cobra("x.yaml", "command: tool run\naliases: [tool r]\noptions:\n - {option: it, value_type: bool}\n - {option: name, value_type: string}\n"))
    assert [(r["id"], r["kind"]) for r in rows] == [("tool run", "SUBCOMMAND"), ("tool run --it", "SWITCH"), ("tool run --name", "FLAG")]
    clap = '#[derive(Parser)]\n#[command(name = "tool")]\nstruct Cli {\n  #[arg(long, short)]\n  config: String,\n  #[arg(long, default_value = "3")]\n  level: u8,\n  #[arg(long, hide = true)]\n  old: bool,\n  #[command(subcommand)]\n  cmd: Cmd,\n}\n#[derive(Subcommand)]\nenum Cmd {\n  RunAll(RunArgs),\n  Stop,\n}\n#[derive(Args)]\nstruct RunArgs {\n  path: String,\n}'
    assert [(r["id"], r["kind"]) for r in C.clap("m.rs", clap)] == [("tool", "SUBCOMMAND"), ("tool --config", "FLAG"), ("tool --level", "CONFIG_KNOB"), ("tool run-all", "SUBCOMMAND"), ("tool run-all <path>", "POSITIONAL"), ("tool stop", "SUBCOMMAND")]


def test_yaml_contracts():
    pytest.importorskip("yaml")
    crd = "kind: CustomResourceDefinition\nspec:\n  group: g.io\n  names: {kind: K}\n  versions:\n  - name: v1\n    schema:\n      openAPIV3Schema:\n        properties:\n          spec:\n            type: object\n            properties:\n              names: {type: array, items: {type: object, properties: {a: {type: string}}}}\n"
    assert ids(C.crd("c.yaml", crd)) == ["g.io", "g.io/K", "g.io/K.spec", "g.io/K.spec.names", "g.io/K.spec.names[].a"]
    k8s = "apiVersion: apps/v1\nkind: D\nspec: {replicas: 1}\n---\nx: {{ t }}\n---\napiVersion: v1\nkind: S\n"
    assert ids(C.k8smanifest("k.yaml", k8s)) == ["apps", "apps/D", "apps/D.spec", "apps/D.spec.replicas", "core", "core/S"]


def test_cpp():
    text = "#ifndef A_H_\n#define A_H_\n#define MAX(a) a\nnamespace x::y {\nclass Z {\n public:\n  int Get() const;\n private:\n  int hid();\n};\nenum class E { A };\nint Free(int a);\nnamespace {\nint Hidden();\n}\n}\n"
    assert ids(C.cppheader("m/a.h", text)) == ["m/MAX", "m/x::y::Z", "m/x::y::Z::Get", "m/x::y::E", "m/x::y::Free"]
    rows = list(C.implements_map("a.cc", "class D : public fidl::WireServer<my_io::Dir> {\n};"))
    assert rows[0]["edges"] == [{"kind": "IMPLEMENTS", "target": "my.io/Dir"}]


def test_test_parsers():
    assert [r["test_id"] for r in T.gtest("a_test.cc", "TEST(Dir, Opens) {}\nMY(F, G) {}", macros=("MY",))] == ["Dir.Opens", "F.G"]
    go = list(T.gotest("d/a_test.go", 'func TestRun(t *testing.T) { t.Run("sub", f); exec.Command("tool", "box", "run", "--rm") }\nfunc TestB(t *testing.T) {}', binary="tool"))
    assert [r["test_id"] for r in go] == ["d/a_test::TestRun", "d/a_test::TestRun/sub", "d/a_test::TestB"]
    assert go[0]["refs"] == ["tool box", "tool box run", "tool box run --rm"] and go[2]["refs"] == []
    assert [r["test_id"] for r in T.rust_test("a.rs", '#[tokio::test]\nasync fn works() { run(&["show", "--all"]) }', binary="tool")] == ["a::works", "a::<tool-invocations>"]
    py = list(T.pytest_cases("test_a.py", "import a.b as m\nclass TestX:\n  def test_y(self):\n    m.Svc.Call()\n  class TestIn:\n    def test_no(self): pass\ndef test_z(): pass"))
    assert [r["name"] for r in py] == ["TestX.test_y", "test_z"] and "a.b.Svc.Call" in py[0]["refs"]
    assert [r["refs"] for r in T.python_invocations("t.py", 'def f():\n  run(["tool", "a", "b", "--x"])\n', binary="tool")] == [["tool a", "tool a b", "tool a b --x"]]


def test_doc_parsers():
    rows = list(D.markdown("a.md", "# T\nUse `a.b.C` and `plain`.\n## U\n#### V\n`x::y`\n```bash\n$ tool run --rm\n```\n", binary="tool"))
    assert [(r["kind"], r["refs"], r["section"]) for r in rows] == [("PROSE_MENTION", ["a.b.C"], ["T"]), ("PROSE_MENTION", ["x::y"], ["T", "U", "V"]), ("PROSE_MENTION", ["--rm"], ["T", "U", "V"]), ("EXAMPLE", ["tool run", "tool run --rm"], ["T", "U", "V"])]
    assert list(D.workflows("a.md", "```\ntool a\n```\n", binary="tool")) == []
    flow = next(iter(D.workflows("a.md", "```\ntool a\ntool b\ntool a\n```\n", binary="tool")))
    assert flow["refs"] == ["tool a", "tool b", "tool a"]
    assert D.flag_tables("<table><tr><th>F</th></tr><tr><td><b>--x</b></td></tr></table>") == "| F |\n| --- |\n| --x |"


def test_bundles():
    z, t = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("my.io/index.md", "## Dir {#Dir}\nSome prose.\n")
    with tarfile.open(fileobj=t, mode="w:gz") as f:
        body = b"# c {#tool_run}\nText\n* --rm removes\n* --rm again\n"
        info = tarfile.TarInfo("a.md")
        info.size = len(body)
        f.addfile(info, io.BytesIO(body))
    assert [r["refs"] for r in D.fidldoc("x.zip", z.getvalue())] == [["my.io/Dir"]]
    assert [r["refs"] for r in D.clidoc("x.tgz", t.getvalue())] == [["tool run"], ["tool run --rm"]]


def test_scan_of_a_folder(spark, tmp_path):
    for name, body in {"a/b.bats": '@test "one" {\n}\n', "x_test.go": "func TestA(t *testing.T) {}\n", "bad_test.py": "def test_(:\n", "test_ok.py": "def test_k(): pass\n", "node_modules/z.bats": '@test "no" {\n', "d.md": "`a.b`\n"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    config = registry.Config.from_json(json.dumps({"adapters": [{"name": n} for n in ("bats", "gotest", "pytest", "markdown")]}))
    every = files.read_files(spark, str(tmp_path))
    out = registry.scan(every, config)
    assert sorted(r.test_id for r in out["tests"].collect()) == ["a/b.bats::one", "test_ok.py::test_k", "x_test::TestA"]
    assert out["claims"].count() == 1 and out["elements"].count() == 0
    broken = files.failures(files.texts(every.where("path like '%.py'")), T.pytest_cases, "pytest")
    assert [r.path for r in broken.collect()] == ["bad_test.py"]
    assert {r.adapter: r.files for r in files.detect(files.texts(every)).collect()} == {"bats": 1, "gotest": 1, "markdown": 1, "pytest": 2}
    with pytest.raises(ValueError, match="unknown"):
        registry.Config.from_json('{"adapters": [{"name": "nope"}]}')


def test_incremental_scan(spark, tmp_path):
    from coverloom.streaming.reindex import changed_files, latest, reindex

    folder = str(tmp_path / "in")
    for body, version in ((b'@test "one" {\n', 1), (b'@test "two" {\n', 2)):
        spark.createDataFrame([("a.bats", bytearray(body), version)], "path string, content binary, version long").write.mode("append").parquet(folder)
        reindex(changed_files(spark, folder), registry.Adapter("bats"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert [r.name for r in latest(spark, str(tmp_path / "out")).collect()] == ["two"]


def test_external_source(spark, tmp_path):
    import sys

    from coverloom.sources.external import external, frame, unframe

    assert unframe(frame({"a": 1})) == {"a": 1}
    with pytest.raises(ValueError, match="frame"):
        unframe(b"\x00\x00\x00\x09{}")
    script = tmp_path / "plugin.py"
    script.write_text("import json, struct, sys\nraw = sys.stdin.buffer.read()\nask = json.loads(raw[4:])\nout = json.dumps({'protocol_version': 1, 'tests': [{'test_id': f['path'], 'line': len(f['text'])} for f in ask['files']]}).encode()\nsys.stdout.buffer.write(struct.pack('>I', len(out)) + out)\n")
    rows = spark.createDataFrame([("a", "xyz"), ("b", "")], "path string, text string")
    assert sorted((r.test_id, r.line) for r in external(rows, [sys.executable, str(script)], "tests").collect()) == [("a", 3), ("b", 0)]


def test_mentions_claim_the_longest_form(spark):
    from coverloom.sources import grounding

    docs = spark.createDataFrame([("d", "# Open Dir\nThe open dir and opens, `open`, open-dir, reopen."), ("n", None), ("e", "")], "path string, text string")
    forms = spark.createDataFrame([("open",), ("open dir",), ("open dir and never",), ("",), ("--",), (None,)], "form string")
    got = sorted((r.path, r.offset, r.form, r.token, r.qualified) for r in grounding.scan(docs, forms).collect())
    assert got == [("d", 15, "open dir", "open dir", False), ("d", 28, "open", "opens", False), ("d", 36, "open", "open", True), ("d", 43, "open", "open", False)]


def test_few_forms_are_looked_up_without_a_row_for_each_run_of_words(spark):
    from coverloom.sources import grounding

    texts = [
        "Open dirs, the open  dir, reopen dir and never more.", "OPEN DIR AND NEVER; open dir andé; a_b c s d", "# open\n```\nopen dir\n```\nÉopen dir and never-evers", "x", "", None,
        "keys key KEYS keyss", "open dir and neversé", "(key) a-b-c-d. a-b-cs-d a-b c-d", "-- : ñ", "open" * 3 + " open dir and never",
    ]
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)] + [("d0", "key"), (None, "key")], "path string, text string")
    forms = spark.createDataFrame([(f,) for f in ("open dir", "Open Dir and never", "open", "key", "keys", "a-b-c-d", "a-b", "(key)", "é", "", "--", "s d", None, "open", "and never.")], "form string")
    got, joined = grounding.scan(docs, forms), grounding.scan(docs, forms, most=0)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan
    assert sorted(map(str, got.collect())) == sorted(map(str, joined.collect()))
    assert got.count() == 17
    assert grounding.few_forms(forms, 11) is None and len(grounding.few_forms(forms, 13)) == 13


def test_lexicon_forms(spark):
    from coverloom.sources import grounding

    rows = grounding.lexicon(spark.createDataFrame([("lib/ReleaseImageService",), ("lib/Service",), ("lib/HTTPServer2",), ("lib/Ab",)], "id string")).collect()
    got = sorted((r.display, r.form, r.collision, r.exact) for r in rows)
    assert got == [
        ("HTTPServer2", "httpserver2", False, True),
        ("ReleaseImageService", "release image service", False, True),
        ("ReleaseImageService", "releaseimageservice", False, True),
        ("ReleaseImageService", "service", True, False),
        ("Service", "service", True, True),
    ]


def test_grounding_anchors_and_suppression(spark):
    from coverloom.sources import grounding

    forms = grounding.lexicon(spark.createDataFrame([("f/Node",), ("f/NodeController",), ("f/Driver",)], "id string"))
    pages = [
        ("reference.md", "# A\n\nA [node][n] runs.\n\n[n]: /ref/f#Node\n", ["GROUNDED", "GROUNDED"]),
        ("other-link.md", "# A\n\nA [node](/glossary#board-nodes) runs.\n", ["GUESSING", "UNGROUNDED"]),
        ("heading.md", "# A\n\n## The node topology\n\nEach node runs.\n", ["GUESSING"]),
        ("bold.md", "# A\n\nThe **driver** runs. A driver stops.\n", ["GROUNDED", "GROUNDED"]),
        ("sections.md", "# A\n\n## B\n\nThe `driver` runs.\n\n## C\n\nA driver stops.\n", ["GROUNDED", "UNGROUNDED"]),
        ("name.md", "# A\n\nOne node controller runs.\n", ["GROUNDED"]),
        ("capital.md", "# A\n\nThe Driver runs.\n", ["GROUNDED"]),
        ("first.md", "# A\n\nDrivers run.\n", ["GUESSING"]),
        ("quiet.md", "# A\n\nA driver runs.\n", []),
        ("muted.md", "# A\n\nA driver meets a node.\n", ["UNGROUNDED"]),
    ]
    docs = spark.createDataFrame([p[:2] for p in pages], "path string, text string")
    muted = spark.createDataFrame([("quiet.md", "*", None), ("muted.md", "Driver", "f/Driver"), ("muted.md", "node", "f/Driver")], "path string, token string, element_id string")
    found = grounding.findings(docs, forms, muted).collect()
    for path, _, states in pages:
        assert [r.state for r in sorted(found, key=lambda r: r.offset) if r.path == path] == states, path
    assert next(r.severity for r in found if r.path == "muted.md") == 0.64  # two terms in the section
    assert next(r.excerpt for r in found if r.path == "first.md") == "Drivers run."


def test_canonical_invocations():
    from coverloom.sources.tests import canonical_invocation as call

    flags = {"valued": frozenset({"target", "config"}), "plain": frozenset({"strict"})}
    assert call(["--target", "dev", "--strict", "audio", "gen", "--rate", "5"], "tool", **flags) == (
        ["tool audio", "tool audio gen"],
        ["tool audio gen --rate", "tool --target", "tool --strict"],
        False,
    )
    assert call(["--config=x", "audio"], "tool", **flags) == (["tool audio"], ["tool --config"], False)
    assert call(["--target"], "tool", **flags) == ([], ["tool --target"], False)
    assert call(["", " "], "tool", **flags) == ([], [], True)
    assert call(["--other", "5"], "tool", **flags) == ([], [], True)


def test_calls_in_the_scope_of_imports():
    from coverloom.sources import tests

    cc = '#include <org/ui/view/cpp/fidl.h>\n#include "fidl/org.io/cpp/wire.h"\nTEST(A, B) { view_ref_->SetAngle(1); x->Get(); dir.Get(); }\n'
    assert next(tests.gtest("a.cc", cc, idl_prefix="org"))["refs"] == ["org.io/*.SetAngle", "org.io/Dir.Get", "org.io/ViewRef.SetAngle", "org.ui.view/*.SetAngle", "org.ui.view/Dir.Get", "org.ui.view/ViewRef.SetAngle"]
    assert next(tests.gtest("a.cc", cc))["refs"] == []
    rs = "use fidl_org_io::*;\n#[test]\nfn reads() { session.get_angle(); session.unwrap(); s.open(); }\n"
    assert next(tests.rust_test("a.rs", rs, idl_prefix="org"))["refs"] == ["org.io/*.GetAngle", "org.io/Session.GetAngle"]


def test_snapshots_are_read_as_written(spark, tmp_path):
    from coverloom.plans import sinks

    def part(name, *rows):
        return spark.createDataFrame(rows, sinks.SNAPSHOT[name])

    def library(name):
        return {
            "elements": part("elements", (f"{name}/A", "TYPE", name, "a.x", 1), (f"{name}/B", "TYPE", name, None, None)),
            "profiles": part("profiles", (f"{name}/A", "TYPE", name, 1, 0, 2, 2, 0, 1, 3, "examples")),
            "findings": part("findings", (f"f:{name}/A", "THIN_REFERENCE", f"{name}/A", "INFO", "thin-reference")),
        }

    whole = sinks.united([library("l"), library("m")])
    sinks.write_snapshot(whole, str(tmp_path / "s"))
    again = sinks.read_snapshot(spark, str(tmp_path / "s"))
    for name, df in whole.items():
        assert again[name].columns == df.columns
        assert sorted(map(tuple, again[name].collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    spark.sql("SELECT 'x' AS id, 9 AS schema_version").write.json(str(tmp_path / "o" / "elements"))
    for name in ("profiles", "findings"):
        whole[name].write.json(str(tmp_path / "o" / name))
    with pytest.raises(Exception, match="snapshot version 9"):
        sinks.read_snapshot(spark, str(tmp_path / "o"))["elements"].collect()


def test_reference_pages_of_images_are_not_shared(spark):
    from coverloom.operators import graph, matching

    rows = spark.createDataFrame([("a", "concept"), ("a", "reference.dockerdoc"), ("b", "reference.clidoc")], "element_id string, bucket string")
    both = graph.bridge_evidence(rows, spark.createDataFrame([("a", "b")], "a string, b string"))
    assert sorted(map(tuple, both.collect())) == [("a", "concept"), ("a", "reference.clidoc"), ("a", "reference.dockerdoc"), ("b", "concept"), ("b", "reference.clidoc")]
    kinds = spark.createDataFrame([("SUBCOMMAND",), ("FLAG",), ("LIBRARY",), ("NEW",), (None,)], "kind string")
    got = kinds.select(matching.admits(kinds.kind, "name_tokens"), matching.admits(kinds.kind, "direct_ref")).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, True), (True, True), (False, True), (False, True)]


def test_generated_files_are_dealt_over_tasks(spark):
    from coverloom.plans import generated

    sf_dir = "/root/testdata/sf0.1"
    if not Path(sf_dir).exists():
        pytest.skip("no driver tables")
    rows = generated.sources(spark, sf_dir, "c<k>.yaml", generated.CRD)
    assert rows.rdd.getNumPartitions() == 5
    assert rows.count() == 20000
