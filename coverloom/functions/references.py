"""References to services and their methods in texts, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_noise_package

_PACKAGE = r"[a-z][a-z0-9_]*(?:\.[a-z0-9_]+)*"
_NAME = r"[A-Z][A-Za-z0-9_]*"
_DECLARED = rf"(?m)(^\s*(?:package\s+{_PACKAGE}\s*;|service\s+{_NAME}\s*\{{|rpc\s+{_NAME}\s*\())"


def _forms(package: Column, name: Column) -> Column:
    """pkg/Name and pkg.Name."""
    return F.array(F.concat(package, F.lit("/"), name), F.concat(package, F.lit("."), name))


def proto_declared(text: Column) -> Column:
    """What declarations name: each service and rpc, within the package and the service that stand before it."""
    start = F.struct(F.lit("").alias("package"), F.lit("").alias("service"), F.array().cast("array<string>").alias("refs"))

    def step(at: Column, token: Column) -> Column:
        kind, name = F.regexp_extract(token, r"^\s*(\w+)", 1), F.regexp_extract(token, r"^\s*\w+\s+([\w.]+)", 1)
        service = F.when(kind == "service", name).otherwise(at["service"])
        within = F.when(kind == "service", name).when(at["service"] != "", F.concat(at["service"], F.lit("."), name)).otherwise(name)
        # an rpc outside any service is known by its own name alone
        scoped = (at["package"] != "") & ((kind == "service") | (at["service"] != ""))
        refs = F.when(kind == "package", F.array().cast("array<string>")).when(scoped, _forms(at["package"], within)).otherwise(F.array(within))
        package = F.when(kind == "package", name).otherwise(at["package"])
        return F.struct(package.alias("package"), service.alias("service"), F.concat(at["refs"], refs).alias("refs"))

    return F.aggregate(F.regexp_extract_all(text, F.lit(_DECLARED)), start, step, lambda at: at["refs"])


def proto_named(text: Column) -> Column:
    """What full names say: pkg.Service, pkg.Service.Method and pkg.Service/Method, without packages that never are contracts."""
    dotted = F.regexp_extract_all(text, F.lit(rf"\b({_PACKAGE}\.{_NAME}(?:\.{_NAME})?)\b"))
    slashed = F.regexp_extract_all(text, F.lit(rf"\b({_PACKAGE}\.{_NAME}/{_NAME})\b"))

    def both(ref: Column) -> Column:
        package = F.regexp_extract(ref, rf"^({_PACKAGE})\.[A-Z]", 1)
        name = F.replace(F.substring(ref, F.length(package) + 2, F.length(ref)), F.lit("/"), F.lit("."))
        return F.when(is_noise_package(package), F.array().cast("array<string>")).otherwise(_forms(package, name))

    return F.flatten(F.transform(F.concat(dotted, slashed), both))


def proto_references(text: Column) -> Column:
    """All references to services and methods in a text, each in its slashed and dotted form, sorted."""
    return F.array_sort(F.array_distinct(F.concat(proto_declared(text), proto_named(text))))
