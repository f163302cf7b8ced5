"""Scalar functions on identifiers, paths, words and versions, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CAMEL_BOUNDARY = r"(?<=[a-z])(?=[A-Z])|(?<=[^a-z])(?=[A-Z][a-z])"
TEST_PREFIX = r"^(Test|Benchmark|Example|Fuzz)"


def lowered(parts: Column) -> Column:
    return F.filter(F.transform(parts, F.lower), lambda x: x != "")


def split_camel(s: Column) -> Column:
    """Lower-cased pieces; a run of capitals stays together up to the capital that begins a word."""
    return lowered(F.split(s, CAMEL_BOUNDARY))


def split_camel_simple(s: Column) -> Column:
    """Splits from lower to upper case only."""
    return lowered(F.split(s, r"(?<=[a-z])(?=[A-Z])"))


def split_mixed(s: Column) -> Column:
    """Pieces of a test name: its prefix dropped, then cut at separators and camel case."""
    return F.flatten(F.transform(F.split(F.regexp_replace(s, TEST_PREFIX, ""), r"[ _\-./+,]+"), split_camel))


def id_tokens(s: Column) -> Column:
    return F.flatten(F.transform(F.split(s, r"[./\-_ ]+"), split_camel))


def path_tokens(path: Column) -> Column:
    """Pieces of a path between / _ - and dots, its extension dropped; case is kept."""
    bare = F.regexp_replace(path, r"\.[^./]*$", "")
    return F.filter(F.split(bare, r"[/_\-.]+"), lambda x: x != "")


def stems(tokens: Column, blocked: Column | None = None) -> Column:
    """The tokens with their singular or plural forms, except forms in `blocked`."""
    free = (lambda x: ~F.array_contains(blocked, x)) if blocked is not None else (lambda x: F.lit(True))

    def forms(t: Column) -> Column:
        stem = F.substring(t, 1, F.length(t) - 1)
        singular = t.endswith("s") & ~t.endswith("ss") & (F.length(stem) >= 3)
        plural = F.concat(t, F.lit("s"))
        return (
            F.when(F.length(t) <= 3, F.array(t))
            .when(t.endswith("s"), F.when(singular & free(stem), F.array(t, stem)).otherwise(F.array(t)))
            .otherwise(F.when(free(plural), F.array(t, plural)).otherwise(F.array(t)))
        )

    return F.array_distinct(F.flatten(F.transform(tokens, forms)))


def last_segment(ref: Column) -> Column:
    """What follows the last / or dot."""
    return F.regexp_extract(ref, r"([^/.]*)$", 1)


def library_of(ref: Column) -> Column:
    return F.regexp_extract(ref, r"^([^/]*)/", 1)


def method_of(ref: Column) -> Column:
    return F.regexp_extract(ref, r"/[^/]*\.([^./]*)$", 1)


def protocol_of(ref: Column) -> Column:
    return F.regexp_extract(ref, r"/([^/]*)\.[^./]*$", 1)


def distinctive_token(library: Column) -> Column:
    """The last piece of a library name that isn't a version such as v1 or v1alpha."""
    kept = F.filter(F.split(F.lower(library), r"[./]"), lambda x: (x != "") & ~x.rlike(r"^v\d[a-z0-9]*$"))
    return F.coalesce(F.try_element_at(kept, F.lit(-1)), F.lit(""))


def alnum_lower(s: Column) -> Column:
    return F.lower(F.regexp_replace(s, r"[^A-Za-z0-9]", ""))


def basename(path: Column) -> Column:
    """The file's name without extension and without a final _test."""
    return F.regexp_replace(F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", ""), r"_test$", "")


def dir_chain(path: Column) -> Column:
    """Lower-cased directories of a path without src, test and tests at the end."""
    dirs = F.regexp_replace(F.lower(F.regexp_replace(path, r"/?[^/]*$", "")), r"((^|/)(src|tests|test))+$", "")
    return F.filter(F.split(dirs, "/"), lambda x: x != "")


def slug(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}]+", "-"), r"^-+|-+$", "")


def short_hash(s: Column, size: int = 8) -> Column:
    return F.substring(F.sha2(s, 256), 1, size)


def word_count(s: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(s, F.lit("")), r"\s+"), lambda x: x != ""))


def percent(n: Column, total: Column) -> Column:
    """Integer percent, halves up, 100 at most, 0 of 0."""
    n, total = n.cast("long"), total.cast("long")
    return F.when(total <= 0, F.lit(0).cast("long")).otherwise(F.least(F.lit(100).cast("long"), F.floor((n * 100 + F.floor(total / 2)) / F.greatest(total, F.lit(1))).cast("long")))


def substance_rank(words: Column, cli: bool = False, empty_is_absent: bool = True) -> Column:
    """1 absent, 2 signature only, 3 partial, 4 substantive."""
    absent = F.lit(1 if empty_is_absent or cli else 2)
    signature, partial = (1, 7) if cli else (4, 19)
    return F.when(words <= 0, absent).when(words <= signature, 2).when(words <= partial, 3).otherwise(4).cast("int")


SUBSTANCE = {0: "UNSPECIFIED", 1: "ABSENT", 2: "SIGNATURE_ONLY", 3: "PARTIAL", 4: "SUBSTANTIVE"}


def substance_name(rank: Column) -> Column:
    out = F.lit(SUBSTANCE[0])
    for r, name in SUBSTANCE.items():
        if r:
            out = F.when(rank == r, F.lit(name)).otherwise(out)
    return out


def removed_at(symbol: Column, target: str) -> Column:
    """Whether a removal level has come at a target level."""
    symbol = F.coalesce(symbol, F.lit(""))
    numeric = symbol.rlike(r"^\d+$")
    if target in ("", "HEAD"):
        gone = symbol != "NEXT"
    elif target.isdigit():
        gone = numeric & (F.when(numeric, symbol).try_cast("int") <= int(target))
    else:
        gone = symbol == target
    return (symbol != "") & F.coalesce(gone, F.lit(False))


def whole_token(text: Column, name: str) -> Column:
    import re

    return text.rlike(rf"(?<![A-Za-z0-9_]){re.escape(name)}(?![A-Za-z0-9_])")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double arithmetic; 0 for vectors of other lengths or of length 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0) | (norm == 0), F.lit(0.0)).otherwise(dot(a, b) / norm)


SEARCH_SEPARATORS = r"[ _\-./,:!?]+"


def search_tokens(s: Column) -> Column:
    """Lower-cased pieces between spaces, underscores, dashes, dots, slashes, commas, colons and the marks ! and ?."""
    return F.filter(F.split(F.lower(s), SEARCH_SEPARATORS), lambda x: x != "")


def overlap(query: Column, own: Column) -> Column:
    """How many of own's tokens the query has; repeated tokens count each time."""
    return F.size(F.filter(own, lambda t: F.array_contains(query, t)))


def severity_confidence(severity: Column) -> Column:
    return F.when(severity == "ERROR", 0.9).when(severity == "WARNING", 0.7).when(severity == "INFO", 0.55).otherwise(0.5)


def is_qualified(mention: Column) -> Column:
    return mention.rlike(r"[. ]|::")


def source_url(template: str, path: Column, line: Column) -> Column:
    return F.replace(F.replace(F.lit(template), F.lit("{path}"), path), F.lit("{line}"), line.cast("string"))


def affordance_name(s: Column) -> Column:
    """The last segment of an id as lower-case words with single underscores between them.

    A prefix up to a colon goes; the last of the segments between slashes and dots counts, in it the last
    word, without the signs of flags and positionals; a capital after a small letter begins a word.
    """
    last = F.regexp_extract(F.regexp_replace(s, r"^[^:]*:", ""), r"([^/.]*)$", 1)
    bare = F.regexp_replace(F.regexp_replace(F.regexp_extract(last, r"([^ ]*)$", 1), r"^-{0,2}<?", ""), r">$", "")
    words = F.lower(F.regexp_replace(F.regexp_replace(bare, r"([a-z])([A-Z])", "$1_$2"), r"-", "_"))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(words, r"[^a-z0-9_]", ""), r"_+", "_"), r"^_|_$", "")


def long_flags(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(--[a-z][a-z0-9-]*)"), F.lit(1)))


def cpp_refs(text: Column) -> Column:
    """Macro calls and qualified names of C++ sources."""
    macros = F.regexp_extract_all(text, F.lit(r"\b([A-Z][A-Z0-9_]{2,})\s*\("), F.lit(1))
    names = F.regexp_extract_all(text, F.lit(r"\b([A-Za-z_]\w*(?:::[A-Za-z_~]\w*)+)"), F.lit(1))
    return F.array_sort(F.array_union(macros, names))


def grounding_severity(state: Column, competing: Column, density: Column) -> Column:
    """How much a finding matters: by state, then by competing referents and by terms of the section, each beyond the first."""
    base = F.when(state == "UNGROUNDED", 0.60).otherwise(0.30)
    blast = F.greatest(F.lit(0.0), F.least(F.lit(0.24), (competing - 1) * 0.12))
    load = F.greatest(F.lit(0.0), F.least(F.lit(0.16), (density - 1) * 0.04))
    return F.when(state == "GROUNDED", 0.0).otherwise(F.least(F.lit(1.0), base + blast + load))


#: Packages that look like a contract's but never are. Fixed values.
NOISE_PACKAGES = ("www", "http", "https", "io", "com", "net", "org")
NOISE_PREFIX = "google.protobuf"


def is_noise_package(package: Column) -> Column:
    return package.isin(*NOISE_PACKAGES) | package.startswith(NOISE_PREFIX)


#: Flags that many commands share. Fixed values.
COMMON_FLAGS = (
    "repo", "config", "help", "verbose", "quiet", "output", "out", "format", "port", "version", "debug", "force",
    "dry-run", "yes", "file", "dir", "path", "name", "all", "json", "base", "library", "ecosystem",
)
QUALIFIED_KINDS = ("METHOD", "PROTOCOL", "TYPE", "SYSCALL", "CPP_METHOD", "CPP_CLASS", "RUST_TYPE", "CPP_FREE_FUNCTION")


def search_term(element_id: Column, kind: Column) -> Column:
    """A string that only this element's uses hold: its flag, or its qualified name; empty where none is distinctive."""
    leaf = F.regexp_replace(F.regexp_extract(element_id, r"([^ ./:]*)$", 1), r"^-+", "")
    flag = F.when((F.length(leaf) >= 2) & ~F.lower(leaf).isin(*COMMON_FLAGS), F.concat(F.lit("--"), leaf)).otherwise("")
    name = F.substring_index(element_id, "/", -1)
    qualified = F.when(name.rlike("[.:]"), name).otherwise("")
    return F.when(kind.isin("FLAG", "SWITCH", "CONFIG_KNOB"), flag).when(kind.isin(*QUALIFIED_KINDS), qualified).otherwise("")


def library_matches(library: Column, pattern: str) -> Column:
    """A library by name, or by a pattern that ends in .* for all below a name."""
    return (library == pattern) | (library.startswith(pattern[:-1]) if pattern.endswith(".*") else F.lit(False))


def library_in_scope(library: Column, libraries: list[str], also: list[str], exclude: list[str]) -> Column:
    """Excluded ones are out; of the rest, all where nothing is named, else those that are."""

    def any_of(patterns: list[str]) -> Column:
        out = F.lit(False)
        for p in patterns:
            out = out | library_matches(library, p)
        return out

    wanted = any_of([*libraries, *also]) if libraries or also else F.lit(True)
    return ~any_of(exclude) & wanted
