"""Files of a repository as rows, and row parsers over them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.globs import SKIPPED_DIRS, included, matches_any
from ..session import reachable

ELEMENTS = "id string, kind string, ecosystem string, library string, path string, line int, doc string, type string, default_value string, aliases array<string>, edges array<struct<kind:string,target:string>>"
TESTS = "test_id string, framework string, name string, path string, line int, name_tokens array<string>, refs array<string>"
CLAIMS = "path string, line int, kind string, adapter string, text string, words int, refs array<string>, section array<string>"
EDGES = "src_id string, kind string, target_id string, path string, line int"
SCHEMAS = {"elements": ELEMENTS, "tests": TESTS, "claims": CLAIMS, "implements": EDGES}

Parser = Callable[..., Iterator[dict]]


def read_files(spark: SparkSession, root: str, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """(path, content) of files below root; paths are relative, and build and version folders are skipped."""
    reachable(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/") + "/"
    rel = F.regexp_replace("path", "^.*?" + "\\Q" + base.removeprefix("file:") + "\\E", "")
    rows = files.select(rel.alias("path"), "content")
    return rows.where(~F.col("path").rlike(SKIPPED_DIRS) & included(F.col("path"), include, exclude))


def texts(files: DataFrame) -> DataFrame:
    return files.select("path", F.decode("content", "UTF-8").alias("text"))


def parse_all(files: DataFrame, parser: Parser, role: str, **options: object) -> DataFrame:
    """Rows of one parser over (path, text) or (path, content), in one pass: (row, path, error).

    A file that can't be read gives one row with its error, and none else. Parsers need line and brace state, so
    they run in Python, one file at a time.
    """
    schema = T._parse_datatype_string(SCHEMAS[role])
    whole = T.StructType([T.StructField("row", schema), T.StructField("path", T.StringType()), T.StructField("error", T.StringType())])
    arrow, names = _arrow(whole), [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for path, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows += [{"row": {n: r.get(n) for n in names}, "path": path} for r in parser(path, body if body is not None else "", **options)]
                except Exception as e:  # noqa: BLE001  one bad file must not end the scan
                    rows = [r for r in rows if r["path"] != path]
                    rows.append({"path": path, "error": f"{type(e).__name__}: {e}"})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.mapInArrow(run, whole)


def parse(files: DataFrame, parser: Parser, role: str, **options: object) -> DataFrame:
    """The rows of parse_all without the files that can't be read."""
    return parse_all(files, parser, role, **options).where("error is null").select("row.*")


def failures(files: DataFrame, parser: Parser, adapter: str, role: str = "tests", **options: object) -> DataFrame:
    """(adapter, path, error) of the files that a parser can't read."""
    return parse_all(files, parser, role, **options).where("error is not null").select(F.lit(adapter).alias("adapter"), "path", "error")


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


DETECT = {
    "fidl": (["**/*.fidl"], r"(?m)^\s*library\s+[\w.]+;"),
    "proto": (["**/*.proto"], r"(?m)^\s*service\s+\w+"),
    "crd": (["**/*.yaml", "**/*.yml"], r"(?m)^kind:\s*CustomResourceDefinition"),
    "k8smanifest": (["**/*.yaml", "**/*.yml"], r"(?m)^apiVersion:"),
    "helmvalues": (["**/values.yaml", "**/values.schema.json"], r"."),
    "clap": (["**/*.rs"], r"derive\([^)]*\b(Parser|Subcommand|Args)\b"),
    "argh": (["**/*.rs"], r"derive\([^)]*\bFromArgs\b"),
    "gotest": (["**/*_test.go"], r"(?m)^func (Test|Benchmark|Fuzz|Example)"),
    "gtest": (["**/*.cc", "**/*.cpp"], r"\bTEST(_F|_P)?\s*\("),
    "rust-test": (["**/*.rs"], r"#\[(\w+::)*test\b"),
    "bats": (["**/*.bats"], r"@test"),
    "pytest": (["**/test_*.py", "**/*_test.py"], r"(?m)^\s*(async )?def test"),
    "cppheader": (["**/*.h", "**/*.hpp"], r"(?m)^\s*(class|struct|namespace)\s"),
    "markdown": (["**/*.md"], r"."),
    "rst": (["**/*.rst"], r"."),
}


def detect(files: DataFrame, samples: int = 5) -> DataFrame:
    """(adapter, files, samples): sources found by extension and a look at the content."""
    hits = F.array_compact(F.array(*(F.when(matches_any(F.col("path"), globs) & F.col("text").rlike(sniff), F.lit(name)) for name, (globs, sniff) in DETECT.items())))
    found = files.select("path", F.explode(hits).alias("adapter")).distinct()
    # the first paths of an adapter come from the first of each of many groups, so none is gathered whole
    part = F.pmod(F.xxhash64("path"), F.lit(1024))
    first = lambda by: F.row_number().over(W.partitionBy(*by).orderBy("path"))
    few = found.withColumn("part", part).withColumn("k", first(("adapter", "part"))).where(F.col("k") <= samples)
    few = few.withColumn("k", first(("adapter",))).where(F.col("k") <= samples)
    paths = few.groupBy("adapter").agg(F.array_sort(F.collect_list("path")).alias("samples"))
    return found.groupBy("adapter").agg(F.count(F.lit(1)).alias("files")).join(paths, "adapter")
