"""Parser queries: one source file of each format for every row of `part`, parsed, with SQL that states the expected rows.

The SQL never reads the files; it derives what a parser must find from `part` itself.
"""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import reachable
from ..sources import contracts, docs, files
from ..sources import tests as cases
from .corpus import load

#: What templates may name: the key, the name in three spellings, and a choice by the key's parity.
FIELDS = """SELECT CAST(p_partkey AS STRING) AS k, p_partkey AS key, replace(p_name, ' ', '_') AS snake, replace(p_name, ' ', '-') AS kebab,
    concat(upper(substr(p_name, 1, 1)), replace(substr(p_name, 2), ' ', 'Xy')) AS camel, replace(p_name, ' ', ',xy') AS words, replace(p_name, ' ', ',') AS plain, CASE WHEN p_partkey % 2 = 0 THEN 'bool' ELSE 'string' END AS vt FROM {part}"""
_P = "WITH p AS (" + FIELDS.format(part="part") + ") "
FILES_PER_TASK = 4096
_NAMES = ("k", "snake", "kebab", "camel", "words", "plain", "vt")


def sources(spark: SparkSession, sf_dir: str, path: str, text: str) -> DataFrame:
    """(path, text) of one file for each row of part."""
    reachable(spark)
    part = load(spark, sf_dir, "part")
    # a small compressed file is one task, but many texts to parse
    rows = spark.sql(FIELDS, part=part.repartition(-(-part.count() // FILES_PER_TASK) or 1))

    def filled(template: str) -> F.Column:
        out = F.lit(template)
        for n in _NAMES:
            out = F.replace(out, F.lit(f"<{n}>"), F.col(n))
        return out

    return rows.select(filled(path).alias("path"), filled(text).alias("text"))


def shown(rows: DataFrame, role: str) -> DataFrame:
    """The rows of a parser with their lists as text."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    listed = lambda c: F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), ",")
    if role == "elements":
        edges = F.array_join(F.transform(F.coalesce("edges", F.array().cast("array<struct<kind:string,target:string>>")), lambda e: F.concat(e["kind"], F.lit(">"), e["target"])), ",")
        return rows.select("id", "kind", "line", F.concat_ws("|", text("type"), text("default_value"), listed("aliases"), edges).alias("detail"))
    if role == "tests":
        return rows.select("test_id", "line", listed("name_tokens").alias("tokens"), listed("refs").alias("refs"))
    return rows.select("path", "line", "kind", "words", listed("refs").alias("refs"), listed("section").alias("section"))


def _query(role: str, parser: Callable, path: str, text: str, native: bool = False, **options: object) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = sources(spark, sf_dir, path, text)
        return shown(parser(own) if native else files.parse(own, parser, role, **options), role)

    return run


def _bundled(own: DataFrame, kind: str) -> DataFrame:
    """(path, content): each text as the page of a zip or tar.gz file of its own; the page's name follows a | in the path."""

    def pack(page: str, text: str) -> bytes:
        raw, body = io.BytesIO(), text.encode()
        if kind == "zip":
            with zipfile.ZipFile(raw, "w") as z:
                z.writestr(page, body)
        else:
            with tarfile.open(fileobj=raw, mode="w:gz") as t:
                info = tarfile.TarInfo(page)
                info.size = len(body)
                t.addfile(info, io.BytesIO(body))
        return raw.getvalue()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = [p.split("|") for p in batch.column(0).to_pylist()]
            bodies = [pack(p[1], t) for p, t in zip(paths, batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in paths], pa.string()), pa.array(bodies, pa.binary())], ["path", "content"])

    return own.mapInArrow(run, "path string, content binary")


def _bundle_query(parser: Callable, kind: str, path: str, text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: shown(files.parse(_bundled(sources(spark, sf_dir, path, text), kind), parser, "claims"), "claims")


def q_flag_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of HTML tables as pipe tables."""
    text = "<table><tr><th>Flag</th><th>Use</th></tr>\n<tr><td><code>--<kebab></code></td><td>sets\n <b><k></b></td></tr></table>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([docs.flag_tables(t) for t in batch.column(1).to_pylist()], pa.string())], ["path", "table"])

    return sources(spark, sf_dir, "p<k>.html", text).mapInArrow(run, "path string, table string")


def q_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a parser can't read, with its error; half of them are broken."""
    own = sources(spark, sf_dir, "test_<k>.py", "def test_<snake>(:\n  pass\n").withColumn("text", F.when(F.regexp_extract("path", r"(\d+)", 1).cast("int") % 2 == 0, F.replace("text", F.lit("(:"), F.lit("():"))).otherwise(F.col("text")))
    return files.failures(own, cases.pytest_cases, "pytest").select("adapter", "path", F.substring_index("error", ":", 1).alias("error"))


FIDL = """library gen.l<k>;

/// Opens <snake>.
protocol Base<k> {
    Close() -> (Status s);
};

@discoverable
open protocol P<k> {
    compose Base<k>;
    // Ghost(Never x);
    Get<camel>(Request r) -> (Reply out);
    strict -> On<camel>(Event e);
};

type T<k> = struct { a int32; };
"""
PROTO = """syntax = "proto3";
package gen.v<k>;

// The service { of <snake>.
service S<k> {
  rpc Get<camel>(Req<k>) returns (stream Rep<k>);
  rpc Put(google.protobuf.Empty) returns (Rep<k>) {}
}

message Req<k> { string a = 1; }
message Rep<k> {}
enum E<k> { ZERO = 0; }
"""
COBRA = """command: tool<k> <kebab>
short: Runs it
aliases: tool<k> x, tool<k> y
options:
  - option: zeta
    value_type: <vt>
    default_value: d<k>
  - option: alpha
    value_type: bool
"""
CLAP = """use clap::Parser;

#[derive(Parser)]
#[command(name = "c<k>")]
struct Cli {
    /// Loud
    #[arg(short, long)]
    verbose: bool,
    #[arg(long = "<kebab>", default_value = "d<k>")]
    other_name: String,
    #[arg(long)]
    max_size: Option<u32>,
    file_name: String,
    #[command(subcommand)]
    action: Action,
}

#[derive(Subcommand)]
enum Action {
    Add(AddArgs),
    ListAll,
}

#[derive(Args)]
struct AddArgs {
    #[arg(long)]
    deep: bool,
}
"""
ARGH = """#[derive(FromArgs)]
#[argh(subcommand, name = "a<k>")]
/// Does it
struct Run {
    /// fast
    #[argh(switch, short = 'f')]
    go_fast: bool,
    #[argh(option, long = "<kebab>", default = "\\"d<k>\\".to_string()")]
    x: String,
    #[argh(option)]
    max_count: u32,
    #[argh(positional)]
    target: String,
}
"""
CML = """{
    program: { runner: "elf" },
    config: {
        enable_<snake>: { type: "bool", default: true },
        size<k>: { type: "uint32" },
    },
}
"""
CRD = """apiVersion: apiextensions.k8s.io/v1
kind: CustomResourceDefinition
spec:
  group: g<k>.io
  names: {kind: K<k>}
  versions:
  - name: v1
    schema:
      openAPIV3Schema:
        properties:
          spec:
            type: object
            properties:
              <camel>: {type: string, enum: [a, b], default: a}
              list: {type: array, items: {type: object, properties: {deep: {type: integer}}}}
---
kind: Other
"""
MANIFEST = """apiVersion: apps.g<k>/v1
kind: Deployment
metadata: {name: x}
spec:
  replicas: 3
  <camel>:
  - name: a
---
apiVersion: v1
kind: Service
spec: {port: 80}
---
kind: {{ .Values.kind }}
"""
HELM_SCHEMA = """{"properties": {"image": {"$ref": "#/$defs/image"}, "<snake>": {"type": "<vt>", "default": 1}}, "$defs": {"image": {"type": "object", "properties": {"tag": {"type": "string"}}}}}"""
HELM_VALUES = """# -- how many
replicas: <k>
image:
  # which
  tag: "<kebab>"
list: [1]
"""
HEADER = """#ifndef G_H_
#define G_H_
#define MAX_<k> 3
/* class Ghost { public: void Never(); }; */
namespace gen {
class C<k> : public Base {
 public:
  C<k>();
  void Get<camel>(int a) const;
 private:
  void Hidden();
};
enum class E<k> { kA };
int Free<camel>(int x);
namespace { int Inner(int x); }
}  // namespace gen
#endif
"""
IMPLS = "class Impl<k> final : public fidl::Server<gen_l<k>::P<k>>, public Other {\n};\nimpl gen::q<k>::P<k>RequestHandler for R<k> {\n}\n"
GN = """pw_facade("log<k>") {
  backend = pw_log_<snake>
  public = [ "public/pw_log/log<k>.h" ]
}
pw_source_set("impl") {
  deps = [ "$dir/pw_log:log<k>.facade" ]
}
"""
BATS = "# comment\n@test \"runs <snake>\" {\n  true\n}\n  @test 'and <k>' {\n}\n@test no\n"
GTEST = """TEST(Suite<k>, Opens<camel>) {
  gen::v<k>::P<k>::Open();
}
TEST_F(Fix<k>, b) { x = "TEST"; }
"""
PROTOCPP = """namespace gen { namespace v<k> {
constexpr char kMethod[] = "gen.v<k>.S/Get";
TEST(STest, Calls<camel>) {
  Call("/gen.w<k>.T/Put"); Use(kMethod);
}
}}
"""
GOTEST = """package x
func TestRun<camel>(t *testing.T) {
	s := "}"  // }
	exec.Command("tool", "box", "run<k>", "--rm")
	t.Run("sub <k>", func(t *testing.T) {})
}
func helper() {}
func BenchmarkB(b *testing.B) {
	args := []string{"box", "--<kebab>"}
}
"""
RUST = """#[tokio::test]
async fn works_<snake>() { gen::v<k>::P<k>::open(); gen::v<k>::P<k>::Open(); }
fn helper() { run(&["no"]) }
#[test]
#[ignore]
fn runs() { run(&["box", "sub", "--all"]); }
"""
PYTEST = """import gen.v<k> as m
class TestX:
    def test_<snake>(self):
        m.Svc.Call()
    class TestIn:
        def test_no(self): pass
def test_z():
    x = "gen.v<k>.A.B"
def helper(): pass
"""
PYTHON = """def f_<k>():
    run(["tool", "a", "b", "c", "d", "--<kebab>"])
x = ("sudo", "tool", "k<k>")
"""
MARKDOWN = """# Top <k>
Use `gen.v<k>.Svc` and `plain`, or --<kebab> here.<wide>
## Sub
#### Deep
`a::<camel>`
```bash
$ tool run --rm
# not `a.b` in code
```
```
gen.v<k>.S/Get
```
""".replace("<wide>", " " * 100)  # what is said around a name reaches no further
RST = """Top <k>
======
Use :ref:`~gen.v<k>.S` and ``a::<camel>`` or ``plain``.

Sub
---
.. fn:: gen.v<k>.S.Get

.. code-block:: bash

   tool run --rm

"""
DOXYGEN = """<doxygen><compounddef id="c<k>" kind="class"><compoundname>gen::C<k></compoundname><briefdescription><para>About <snake> here.</para></briefdescription><location file="c<k>.h" line="7"/>
<sectiondef><memberdef id="m<k>"><name>Get</name><detaileddescription><para>Gets it.</para></detaileddescription><location file="c<k>.h" line="9"/></memberdef>
<memberdef id="n<k>"><name>Silent</name><briefdescription></briefdescription></memberdef></sectiondef></compounddef>
<compounddef id="d" kind="dir"><compoundname>dir</compoundname><briefdescription><para>No.</para></briefdescription></compounddef></doxygen>"""
MDCLI = """---
title: "tool <kebab>"
---
# other
| `--alpha` | sets it |
| `--<kebab>` | also |

```
tool <kebab> --alpha 1
```
"""
FLOW = "```\ntool a\n$ tool b<k>\n```\ntext tool c\n```\nsudo tool a\n```\n"
YAML_FLOW = """Title
.. code-block:: yaml

   one: gen.v<k>.S.Get
   two: gen.v<k>.S.Put
   again: gen.v<k>.S.Get

.. code-block:: yaml

   one: gen.v<k>.S.Get

"""
PAGE = "# Dir {#P<k>}\nSome prose about <snake>.\n\n| table |\n```\ncode\n```\n## Next {#P<k>.Get}\nMore.\n"
CLI_PAGE = "# c {#tool_<kebab>}\nText here\n* --rm removes\n* --rm again\n- `--k<k>` too\n"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "parse_fidl": _query("elements", contracts.fidl, "gen/l<k>.fidl", FIDL),
    "parse_proto": _query("elements", contracts.proto, "gen/v<k>.proto", PROTO),
    "parse_cobra": _query("elements", contracts.cobra, "docs/tool<k>.yaml", COBRA),
    "parse_clap": _query("elements", contracts.clap, "src/c<k>.rs", CLAP),
    "parse_argh": _query("elements", contracts.argh, "src/a<k>.rs", ARGH),
    "parse_cml": _query("elements", contracts.cml, "comp<k>/meta.cml", CML),
    "parse_crd": _query("elements", contracts.crd, "crd<k>.yaml", CRD),
    "parse_k8smanifest": _query("elements", contracts.k8smanifest, "m<k>.yaml", MANIFEST),
    "parse_helm_schema": _query("elements", contracts.helm_schema, "chart<k>/values.schema.json", HELM_SCHEMA),
    "parse_helm_values": _query("elements", contracts.helm_values, "chart<k>/values.yaml", HELM_VALUES),
    "parse_cppheader": _query("elements", contracts.cppheader, "mod<k>/c.h", HEADER),
    "parse_implements_map": _query("elements", contracts.implements_map, "src/i<k>.cc", IMPLS),
    "parse_facades": _query("elements", contracts.facades, "pw/m<k>/BUILD.gn", GN),
    "parse_bats": _query("tests", cases.bats, "t<k>.bats", BATS, native=True),
    "parse_gtest": _query("tests", cases.gtest, "t<k>_test.cc", GTEST),
    "parse_protocpp": _query("tests", cases.protocpp, "t<k>_test.cc", PROTOCPP, idl_prefix="gen"),
    "parse_gotest": _query("tests", cases.gotest, "t<k>_test.go", GOTEST, binary="tool"),
    "parse_rust_test": _query("tests", cases.rust_test, "src/t<k>.rs", RUST, binary="tool"),
    "parse_pytest": _query("tests", cases.pytest_cases, "test_<k>.py", PYTEST, prefix="gen."),
    "parse_python_test": _query("tests", cases.python_invocations, "run_<k>.py", PYTHON, binary="tool"),
    "parse_markdown": _query("claims", docs.markdown, "d<k>.md", MARKDOWN, binary="tool"),
    "parse_rst": _query("claims", docs.rst, "d<k>.rst", RST, binary="tool"),
    "parse_doxygen": _query("claims", docs.doxygen, "x<k>.xml", DOXYGEN),
    "parse_markdowncli": _query("claims", docs.markdowncli, "c<k>.md", MDCLI, binary="tool"),
    "parse_workflows": _query("claims", docs.workflows, "w<k>.md", FLOW, binary="tool"),
    "parse_yaml_workflows": _query("claims", docs.yaml_workflows, "w<k>.rst", YAML_FLOW, prefix="gen"),
    "parse_fidldoc": _bundle_query(docs.fidldoc, "zip", "x<k>.zip|gen.l<k>/index.md", PAGE),
    "parse_clidoc": _bundle_query(docs.clidoc, "tar", "x<k>.tgz|pages/c<k>.md", CLI_PAGE),
    "flag_tables": q_flag_tables,
    "parse_failures": q_failures,
}


def _rows(columns: str, *rows: str) -> str:
    """SQL for rows that every row of p has; each is a list of expressions."""
    names = columns.split(", ")
    return _P + " UNION ALL ".join("SELECT " + ", ".join(f"{e} AS {n}" for n, e in zip(names, _split(r), strict=True)) + " FROM p" for r in rows)


def _split(row: str) -> list[str]:
    """The expressions of a row, apart at semicolons; <name> stands for a field within a string."""
    out = []
    for e in row.split(";"):
        e = e.strip()
        if not e.startswith("'"):
            out.append(e)
            continue
        for n in _NAMES:
            e = e.replace(f"<{n}>", f"' || {n} || '")
        out.append(e)
    return out


_E, _T, _C = "id, kind, line, detail", "test_id, line, tokens, refs", "path, line, kind, words, refs, section"

ORACLE_SQL = {
    "parse_fidl": _rows(
        _E,
        "'gen.l<k>/Base<k>'; 'PROTOCOL'; 4; '|||'",
        "'gen.l<k>/Base<k>.Close'; 'METHOD'; 5; '||gen.l<k>.Base<k>.Close|RETURNS>gen.l<k>/Status'",
        "'gen.l<k>/P<k>'; 'PROTOCOL'; 9; '|||COMPOSED_FROM>gen.l<k>/Base<k>'",
        "'gen.l<k>/P<k>.Get<camel>'; 'METHOD'; 12; '||gen.l<k>.P<k>.Get<camel>|ACCEPTS>gen.l<k>/Request,RETURNS>gen.l<k>/Reply'",
        "'gen.l<k>/P<k>.On<camel>'; 'METHOD'; 13; '||gen.l<k>.P<k>.On<camel>|ACCEPTS>gen.l<k>/Event'",
        "'gen.l<k>/T<k>'; 'TYPE'; 16; '|||'",
    ),
    "parse_proto": _rows(
        _E,
        "'gen.v<k>/S<k>'; 'PROTOCOL'; 5; '||gen.v<k>.S<k>|'",
        "'gen.v<k>/S<k>.Get<camel>'; 'METHOD'; 6; '||gen.v<k>.S<k>.Get<camel>|ACCEPTS>gen.v<k>/Req<k>,RETURNS>gen.v<k>/Rep<k>'",
        "'gen.v<k>/S<k>.Put'; 'METHOD'; 7; '||gen.v<k>.S<k>.Put|RETURNS>gen.v<k>/Rep<k>'",
        "'gen.v<k>/Req<k>'; 'TYPE'; 10; '|||'",
        "'gen.v<k>/Rep<k>'; 'TYPE'; 11; '|||'",
        "'gen.v<k>/E<k>'; 'TYPE'; 12; '|||'",
    ),
    "parse_cobra": _rows(
        _E,
        "'tool<k> <kebab>'; 'SUBCOMMAND'; 1; '||tool<k> x,tool<k> y|'",
        "'tool<k> <kebab> --alpha'; 'SWITCH'; 1; 'bool||tool<k> x --alpha,tool<k> y --alpha|'",
        "'tool<k> <kebab> --zeta'; CASE WHEN key % 2 = 0 THEN 'SWITCH' ELSE 'FLAG' END; 1; '<vt>|d<k>|tool<k> x --zeta,tool<k> y --zeta|'",
    ),
    "parse_clap": _rows(
        _E,
        "'c<k>'; 'SUBCOMMAND'; 5; '|||'",
        "'c<k> --verbose'; 'SWITCH'; 1; 'bool||--verbose,-v|'",
        "'c<k> --<kebab>'; 'CONFIG_KNOB'; 1; 'String|d<k>|--<kebab>|'",
        "'c<k> --max-size'; 'FLAG'; 1; 'Option<u32>||--max-size|'",
        "'c<k> <file_name>'; 'POSITIONAL'; 1; 'String|||'",
        "'c<k> add'; 'SUBCOMMAND'; 25; '|||'",
        "'c<k> add --deep'; 'SWITCH'; 1; 'bool||--deep|'",
        "'c<k> list-all'; 'SUBCOMMAND'; 1; '|||'",
    ),
    "parse_argh": _rows(
        _E,
        "'a<k>'; 'SUBCOMMAND'; 1; '|||'",
        "'a<k> --go-fast'; 'SWITCH'; 1; 'bool|||'",
        "'a<k> --<kebab>'; 'CONFIG_KNOB'; 1; 'String|d<k>||'",
        "'a<k> --max-count'; 'FLAG'; 1; 'u32|||'",
        "'a<k> <target>'; 'POSITIONAL'; 1; 'String|||'",
    ),
    "parse_cml": _rows(
        _E,
        "'cml:comp<k>/enable_<snake>'; 'CONFIG_KNOB'; 4; 'bool|true||'",
        "'cml:comp<k>/size<k>'; 'CONFIG_KNOB'; 5; 'uint32|||'",
    ),
    "parse_crd": _rows(
        _E,
        "'g<k>.io'; 'LIBRARY'; 1; '|||'",
        "'g<k>.io/K<k>'; 'TYPE'; 1; '|||'",
        "'g<k>.io/K<k>.spec'; 'CONFIG_KNOB'; 1; 'object|||'",
        '\'g<k>.io/K<k>.spec.<camel>\'; \'CONFIG_KNOB\'; 1; \'string,a|b|"a"||\'',
        "'g<k>.io/K<k>.spec.list'; 'CONFIG_KNOB'; 1; 'array|||'",
        "'g<k>.io/K<k>.spec.list[].deep'; 'CONFIG_KNOB'; 1; 'integer|||'",
    ),
    "parse_k8smanifest": _rows(
        _E,
        "'apps.g<k>'; 'LIBRARY'; 1; '|||'",
        "'apps.g<k>/Deployment'; 'TYPE'; 1; '|||'",
        "'apps.g<k>/Deployment.spec'; 'CONFIG_KNOB'; 1; '|||'",
        "'apps.g<k>/Deployment.spec.replicas'; 'CONFIG_KNOB'; 1; '|3||'",
        "'apps.g<k>/Deployment.spec.<camel>'; 'CONFIG_KNOB'; 1; '|||'",
        '\'apps.g<k>/Deployment.spec.<camel>[].name\'; \'CONFIG_KNOB\'; 1; \'|"a"||\'',
        "'core'; 'LIBRARY'; 1; '|||'",
        "'core/Service'; 'TYPE'; 1; '|||'",
        "'core/Service.spec'; 'CONFIG_KNOB'; 1; '|||'",
        "'core/Service.spec.port'; 'CONFIG_KNOB'; 1; '|80||'",
    ),
    "parse_helm_schema": _rows(
        _E,
        "'chart<k>'; 'LIBRARY'; 1; '|||'",
        "'chart<k>.image'; 'CONFIG_KNOB'; 1; 'object|||'",
        "'chart<k>.image.tag'; 'CONFIG_KNOB'; 1; 'string|||'",
        "'chart<k>.<snake>'; 'CONFIG_KNOB'; 1; '<vt>|1||'",
    ),
    "parse_helm_values": _rows(
        _E,
        "'chart<k>'; 'LIBRARY'; 1; '|||'",
        "'chart<k>.replicas'; 'CONFIG_KNOB'; 1; '|<k>||'",
        "'chart<k>.image'; 'CONFIG_KNOB'; 1; '|||'",
        '\'chart<k>.image.tag\'; \'CONFIG_KNOB\'; 1; \'|"<kebab>"||\'',
        "'chart<k>.list'; 'CONFIG_KNOB'; 1; '|||'",
    ),
    "parse_cppheader": _rows(
        _E,
        "'mod<k>/MAX_<k>'; 'CPP_MACRO'; 3; '|||'",
        "'mod<k>/gen::C<k>'; 'CPP_CLASS'; 6; '|||EXTENDS>Base'",
        "'mod<k>/gen::C<k>::Get<camel>'; 'METHOD'; 9; '|||'",
        "'mod<k>/gen::E<k>'; 'TYPE'; 13; '|||'",
        "'mod<k>/gen::Free<camel>'; 'CPP_FREE_FUNCTION'; 14; '|||'",
    ),
    "parse_implements_map": _rows(
        _E,
        "'cpp:src/i<k>.cc#Impl<k>'; 'CPP_CLASS'; 1; '|||IMPLEMENTS>gen.l<k>/P<k>'",
        "'cpp:src/i<k>.cc#R<k>'; 'CPP_CLASS'; 1; '|||IMPLEMENTS>gen.q<k>/P<k>'",
    ),
    "parse_facades": _rows(
        _E,
        "'pw/m<k>:log<k>'; 'LIBRARY'; 1; '|pw_log_<snake>|public/pw_log/log<k>.h|'",
        "'pw/m<k>:impl'; 'LIBRARY'; 5; '|||BACKEND_OF>dir/pw_log:log<k>'",
    ),
    "parse_bats": _rows(
        _T,
        "'t<k>.bats::runs <snake>'; 2; ''; ''",
        "'t<k>.bats::and <k>'; 5; ''; ''",
    ),
    "parse_gtest": _rows(
        _T,
        "'Suite<k>.Opens<camel>'; 1; 'suite<k>,opens,<words>'; 'gen.v<k>/P<k>.Open'",
        "'Fix<k>.b'; 4; 'fix<k>,b'; ''",
    ),
    "parse_protocpp": _rows(
        _T,
        "'STest.Calls<camel>'; 3; 's,test,calls,<words>'; 'gen.v<k>.S,gen.v<k>.S/Get,gen.w<k>.T/Put'",
    ),
    "parse_gotest": _rows(
        _T,
        "'t<k>_test::TestRun<camel>'; 2; 'run,<words>'; 'tool box,tool box run<k>,tool box run<k> --rm'",
        "'t<k>_test::TestRun<camel>/sub <k>'; 5; 'run,<words>,sub,<k>'; 'tool box,tool box run<k>,tool box run<k> --rm'",
        "'t<k>_test::BenchmarkB'; 8; 'b'; 'tool box,tool box --<kebab>'",
    ),
    "parse_rust_test": _rows(
        _T,
        "'src::t<k>::works_<snake>'; 1; 'works,<plain>'; 'gen.v<k>/P<k>.Open'",
        "'src::t<k>::runs'; 4; 'runs'; 'tool box,tool box sub,tool box sub --all'",
        "'src::t<k>::<tool-invocations>'; 1; ''; 'tool box,tool box sub,tool box sub --all'",
    ),
    "parse_pytest": _rows(
        _T,
        "'test_<k>.py::TestX.test_<snake>'; 3; 'x,test,<plain>'; 'gen.v<k>.Svc,gen.v<k>.Svc.Call,gen.v<k>/Svc.Call,gen/v<k>.Svc'",
        "'test_<k>.py::test_z'; 7; 'test,z'; 'gen.v<k>.A.B,gen.v<k>/A.B'",
    ),
    "parse_python_test": _rows(
        _T,
        "'run_<k>.py::<tool-invocations>'; 1; '<tool,invocations>'; 'tool k<k>'",
        "'run_<k>.py::f_<k>'; 1; 'f,<k>'; 'tool a,tool a b,tool a b c,tool a b c --<kebab>'",
    ),
    "parse_markdown": _rows(
        _C,
        "'d<k>.md'; 2; 'PROSE_MENTION'; 10; 'gen.v<k>.Svc'; 'Top <k>'",
        "'d<k>.md'; 5; 'PROSE_MENTION'; 5; 'a::<camel>'; 'Top <k>,Sub,Deep'",
        "'d<k>.md'; 2; 'PROSE_MENTION'; 10; '--<kebab>'; 'Top <k>'",
        "'d<k>.md'; 7; 'PROSE_MENTION'; 19; '--rm'; 'Top <k>,Sub,Deep'",
        "'d<k>.md'; 6; 'EXAMPLE'; 9; 'tool run,tool run --rm'; 'Top <k>,Sub,Deep'",
        "'d<k>.md'; 10; 'REFERENCE'; 1; 'gen.v<k>.S/Get'; 'Top <k>,Sub,Deep'",
    ),
    "parse_rst": _rows(
        _C,
        "'d<k>.rst'; 3; 'PROSE_MENTION'; 14; 'gen.v<k>.S'; 'Top <k>'",
        "'d<k>.rst'; 3; 'PROSE_MENTION'; 14; 'a::<camel>'; 'Top <k>'",
        "'d<k>.rst'; 7; 'REFERENCE'; 1; 'gen.v<k>.S.Get'; 'Top <k>,Sub'",
        "'d<k>.rst'; 9; 'EXAMPLE'; 3; 'tool run,tool run --rm'; 'Top <k>,Sub'",
    ),
    "parse_doxygen": _rows(
        _C,
        "'c<k>.h'; 7; 'REFERENCE'; 3; 'gen::C<k>'; ''",
        "'c<k>.h'; 9; 'REFERENCE'; 2; 'gen::C<k>::Get'; ''",
    ),
    "parse_markdowncli": _rows(
        _C,
        "'c<k>.md'; 1; 'REFERENCE'; 18; 'tool <kebab>'; ''",
        "'c<k>.md'; 5; 'REFERENCE'; 3; 'tool <kebab> --alpha'; ''",
        "'c<k>.md'; 6; 'REFERENCE'; 2; 'tool <kebab> --<kebab>'; ''",
        "'c<k>.md'; 8; 'EXAMPLE'; 4; 'tool <kebab>'; ''",
        "'c<k>.md'; 8; 'EXAMPLE'; 4; 'tool <kebab> --alpha'; ''",
    ),
    "parse_workflows": _rows(
        _C,
        "'w<k>.md'; 1; 'WORKFLOW'; 8; 'tool a,tool b<k>,tool a'; ''",
    ),
    "parse_yaml_workflows": _rows(
        _C,
        "'w<k>.rst#L2'; 2; 'WORKFLOW'; 6; 'gen.v<k>/S.Get,gen.v<k>/S.Put'; ''",
    ),
    "parse_fidldoc": _rows(
        _C,
        "'gen.l<k>/index.md'; 1; 'REFERENCE'; 4; 'gen.l<k>/P<k>'; ''",
        "'gen.l<k>/index.md'; 8; 'REFERENCE'; 1; 'gen.l<k>/P<k>.Get'; ''",
    ),
    "parse_clidoc": _rows(
        _C,
        "'pages/c<k>.md'; 1; 'REFERENCE'; 11; 'tool <kebab>'; ''",
        "'pages/c<k>.md'; 3; 'REFERENCE'; 0; 'tool <kebab> --rm'; ''",
        "'pages/c<k>.md'; 5; 'REFERENCE'; 0; 'tool <kebab> --k<k>'; ''",
    ),
    "flag_tables": _rows(
        "path, table",
        "'p<k>.html'; '| Flag | Use |' || chr(10) || '| --- | --- |' || chr(10) || '| --<kebab> | sets <k> |'",
    ),
    "parse_failures": _P + "SELECT 'pytest' AS adapter, 'test_' || k || '.py' AS path, 'SyntaxError' AS error FROM p WHERE key % 2 = 1",
}
