"""Sources by name, configuration, and the scan that unites them."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import os
import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import contracts, docs, files
from . import tests as cases


@dataclasses.dataclass(frozen=True)
class Source:
    role: str
    include: tuple[str, ...]
    parser: Callable
    native: bool = False
    binary: bool = False


SOURCES: dict[str, Source] = {
    "fidl": Source("elements", ("**/*.fidl",), contracts.fidl),
    "proto": Source("elements", ("**/*.proto",), contracts.proto),
    "cobra": Source("elements", ("**/*.yaml", "**/*.yml"), contracts.cobra),
    "clap": Source("elements", ("**/*.rs",), contracts.clap),
    "argh": Source("elements", ("**/*.rs",), contracts.argh),
    "cml": Source("elements", ("**/*.cml",), contracts.cml),
    "crd": Source("elements", ("**/*.yaml", "**/*.yml"), contracts.crd),
    "k8smanifest": Source("elements", ("**/*.yaml", "**/*.yml"), contracts.k8smanifest),
    "helm-schema": Source("elements", ("**/values.schema.json",), contracts.helm_schema),
    "helm-values": Source("elements", ("**/values.yaml",), contracts.helm_values),
    "cppheader": Source("elements", ("**/*.h", "**/*.hpp"), contracts.cppheader),
    "implements-map": Source("elements", ("**/*.cc", "**/*.h", "**/*.rs"), contracts.implements_map),
    "facades": Source("elements", ("**/BUILD.gn",), contracts.facades),
    "bats": Source("tests", ("**/*.bats",), cases.bats, native=True),
    "gtest": Source("tests", ("**/*_test.cc", "**/*_unittest.cc"), cases.gtest),
    "protocpp": Source("tests", ("**/*_test.cc", "**/*_unittest.cc"), cases.protocpp),
    "gotest": Source("tests", ("**/*_test.go",), cases.gotest),
    "rust-test": Source("tests", ("**/*.rs",), cases.rust_test),
    "pytest": Source("tests", ("**/test_*.py", "**/*_test.py"), cases.pytest_cases),
    "python-test": Source("tests", ("**/*.py",), cases.python_invocations),
    "markdown": Source("claims", ("**/*.md",), docs.markdown),
    "rst": Source("claims", ("**/*.rst",), docs.rst),
    "doxygen": Source("claims", ("**/*.xml",), docs.doxygen),
    "fidldoc": Source("claims", ("**/*.zip",), docs.fidldoc, binary=True),
    "clidoc": Source("claims", ("**/*.tar.gz", "**/*.tgz"), docs.clidoc, binary=True),
    "markdowncli": Source("claims", ("**/*.md",), docs.markdowncli),
    "workflows": Source("claims", ("**/*.md",), docs.workflows),
    "yaml-workflows": Source("claims", ("**/*.rst",), docs.yaml_workflows),
}


@dataclasses.dataclass
class Adapter:
    name: str
    include: list[str] = dataclasses.field(default_factory=list)
    exclude: list[str] = dataclasses.field(default_factory=list)
    options: dict = dataclasses.field(default_factory=dict)


@dataclasses.dataclass
class Config:
    adapters: list[Adapter]
    rules: list[dict] = dataclasses.field(default_factory=list)

    @classmethod
    def from_json(cls, text: str) -> Config:
        """A configuration with ${NAME} taken from the environment."""
        if missing := sorted({n for n in re.findall(r"\$\{(\w+)\}", text) if n not in os.environ}):
            raise ValueError(f"unset in the environment: {', '.join(missing)}")
        raw = json.loads(re.sub(r"\$\{(\w+)\}", lambda m: os.environ[m[1]], text))
        out = cls([Adapter(**a) for a in raw.get("adapters", [])], raw.get("rules", []))
        out.validate()
        return out

    def validate(self) -> None:
        unknown = [a.name for a in self.adapters if a.name not in SOURCES]
        if unknown:
            raise ValueError(f"unknown adapters: {', '.join(sorted(unknown))}")
        if bad := [r for r in self.rules if not r.get("dotted_path") or not r.get("paths")]:
            raise ValueError(f"rules without dotted_path or paths: {bad}")


def from_detection(found: DataFrame) -> Config:
    """A configuration with every detected source that has a parser."""
    return Config([Adapter(r["adapter"]) for r in found.select("adapter").orderBy("adapter").collect() if r["adapter"] in SOURCES])  # a row a source


def own_files(all_files: DataFrame, adapter: Adapter) -> DataFrame:
    source = SOURCES[adapter.name]
    own = all_files.where(files.included(F.col("path"), adapter.include or source.include, adapter.exclude))
    return own if source.binary else files.texts(own)


def read(all_files: DataFrame, adapter: Adapter) -> DataFrame:
    source, own = SOURCES[adapter.name], own_files(all_files, adapter)
    rows = source.parser(own) if source.native else files.parse(own, source.parser, source.role, **adapter.options)
    return rows.withColumn("source", F.lit(adapter.name)).withColumn("tier", F.lit("DETERMINISTIC"))


def errors(all_files: DataFrame, config: Config) -> DataFrame:
    """(adapter, path, error) of every file that its source can't read."""
    parts = [files.failures(own_files(all_files, a), SOURCES[a.name].parser, a.name, SOURCES[a.name].role, **a.options) for a in config.adapters if not SOURCES[a.name].native]
    return reduce(DataFrame.unionByName, parts) if parts else all_files.sparkSession.createDataFrame([], "adapter string, path string, error string")


def scan(all_files: DataFrame, config: Config) -> dict[str, DataFrame]:
    """elements, tests and claims of all sources. A chart's schema suppresses its values file."""
    out: dict[str, list[DataFrame]] = {r: [] for r in files.SCHEMAS}
    for a in config.adapters:
        out[SOURCES[a.name].role].append(read(all_files, a))
    spark = all_files.sparkSession
    empty = lambda r: spark.createDataFrame([], files.SCHEMAS[r] + ", source string, tier string")
    united = {r: reduce(DataFrame.unionByName, parts) if parts else empty(r) for r, parts in out.items()}
    own = united["elements"]
    schema_charts = own.where("source = 'helm-schema'").select("library").distinct()
    rest = own.where("source <> 'helm-values'")
    united["elements"] = rest.unionByName(own.where("source = 'helm-values'").join(schema_charts, "library", "left_anti").select(own.columns))
    return united


def health(spark: SparkSession, root: str) -> bool:
    """Whether files below root can be listed."""
    try:
        files.read_files(spark, root).limit(1).count()
    except Exception:  # noqa: BLE001
        return False
    return True


def cache_key(config: Config, commit: str, libraries: Sequence[str] = ()) -> str:
    body = json.dumps([dataclasses.asdict(config), commit, sorted(libraries)], sort_keys=True)
    return hashlib.sha256(body.encode()).hexdigest()


def store_snapshot(df: DataFrame, root: str, key: str, name: str) -> None:
    df.write.mode("overwrite").parquet(f"{root}/cache_key={key}/{name}")


def load_snapshot(spark: SparkSession, root: str, key: str, name: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/cache_key={key}/{name}")
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return spark.read.parquet(str(path)) if fs.exists(path) else None
