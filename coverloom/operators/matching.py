"""Joins of references with contract elements. Every theta predicate becomes an equi join on exploded keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Kinds that names of tests may attest, beside direct references, which all kinds admit. Fixed values.
NAME_TOKEN_KINDS = ("SUBCOMMAND", "LIBRARY", "CONFIG_FACET")


def admits(kind: Column, strategy: str) -> Column:
    """Whether a kind admits a strategy, direct_ref or name_tokens; unknown kinds admit direct references only."""
    if strategy == "direct_ref":
        return F.lit(True)
    return F.coalesce(kind.isin(*NAME_TOKEN_KINDS), F.lit(False)) if strategy == "name_tokens" else F.lit(False)


def shuffled(rows: DataFrame) -> DataFrame:
    """Joins with these rows go through a shuffle: Spark takes derived rows for as small as the compressed file below them."""
    return rows.hint("merge")


def exact(refs: DataFrame, elements: DataFrame) -> DataFrame:
    """(owner, element_id) where a reference is an element's id. refs has (owner, ref)."""
    return refs.join(elements.select(F.col("id").alias("element_id")), F.col("ref") == F.col("element_id")).select("owner", "element_id")


def by_alias(refs: DataFrame, elements: DataFrame) -> DataFrame:
    keys = elements.select(F.col("id").alias("element_id"), F.explode("aliases").alias("alias"))
    return refs.join(keys, F.col("ref") == F.col("alias")).select("owner", "element_id")


def suffixes(elements: DataFrame, key: str = "id") -> DataFrame:
    """(element_id, suffix): what follows each / and each dot of the key."""
    return elements.select(F.col("id").alias("element_id"), F.explode(F.array_distinct(_tails(F.col(key), "[/.]"))).alias("suffix"))


def _tails(key: Column, separators: str) -> Column:
    """What follows each separator of one character; measured from the end, so no character is looked at twice."""
    pieces = F.split(key, separators)
    n = F.size(pieces)
    rest = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: i < n)
    return F.transform(rest, lambda i: F.right(key, F.length(F.array_join(F.slice(pieces, i + 1, n), "/"))))


def doc_keys(elements: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(key, element_id), once each: every string by which documentation names an element."""
    keyed = elements.select("id", F.col("id").alias("key")) if edges is None else inherited_keys(elements, edges)
    names = F.array_distinct(F.concat(F.array("key"), _tails(F.col("key"), "[/.]")))
    own = keyed.select(F.explode(names).alias("key"), F.col("id").alias("element_id"))
    aliases = elements.select(F.explode("aliases").alias("key"), F.col("id").alias("element_id"))
    return own.unionByName(aliases).distinct()


def test_keys(elements: DataFrame) -> DataFrame:
    """(key, element_id), once each: ids, aliases, and for methods library/*.tail for each dotted tail."""
    tails = F.when(F.col("kind") == "METHOD", F.transform(_tails(F.col("id"), "[.]"), lambda t: F.concat(F.col("library"), F.lit("/*."), t)))
    names = F.concat(F.array("id"), F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce(tails, F.array().cast("array<string>")))
    return elements.select(F.explode(F.array_distinct(names)).alias("key"), F.col("id").alias("element_id"))


def matched(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows with each element that their `ref` names; one join for all ways of naming."""
    return rows.join(shuffled(keys), F.col("ref") == F.col("key")).drop("key")


def by_suffix(refs: DataFrame, elements: DataFrame) -> DataFrame:
    return refs.join(suffixes(elements), F.col("ref") == F.col("suffix")).select("owner", "element_id")


def by_wildcard(refs: DataFrame, elements: DataFrame) -> DataFrame:
    """References lib/*.Method reach each method of that name in the library."""
    parsed = refs.select("owner", F.regexp_extract("ref", r"^(.+?)/\*\.(.+)$", 1).alias("lib"), F.regexp_extract("ref", r"^(.+?)/\*\.(.+)$", 2).alias("method")).where("lib <> ''")
    # the method itself may hold dots, so every dotted tail of an id is a key
    tails = elements.where("kind = 'METHOD'").select("id", "library", F.filter(F.sequence(F.lit(1), F.length("id")), lambda i: F.substring("id", i, F.lit(1)) == ".").alias("dots"))
    keys = tails.select(F.col("id").alias("element_id"), "library", F.explode(F.transform("dots", lambda i: F.substring(F.col("id"), i + 1, F.length("id")))).alias("tail"))
    return parsed.join(keys, (F.col("lib") == F.col("library")) & (F.col("method") == F.col("tail"))).select("owner", "element_id")


def inherited_keys(elements: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, key): each element under its own id and under those of the methods that it inherits."""
    own = elements.select("id", F.col("id").alias("key"))
    parents = edges.where("kind = 'INHERITED_FROM'").select(F.col("src_id").alias("id"), F.col("target_id").alias("key"))
    return own.unionByName(parents.join(shuffled(elements.select("id")), "id", "left_semi"))


def doc_matches(refs: DataFrame, elements: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(owner, element_id), once each: exact, suffix (also of inherited methods), and alias."""
    return matched(refs, doc_keys(elements, edges)).select("owner", "element_id").distinct()


def doc_match_counts(refs: DataFrame, elements: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(element_id, n): the owners that doc_matches gives an element, without a row for each pair.

    Owners of the same references are one class; a class meets the elements once and counts with its owners.
    """
    said = refs.where("ref is not null").groupBy("owner").agg(F.array_sort(F.collect_set("ref")).alias("refs"))
    classes = said.groupBy("refs").agg(F.count(F.lit(1)).alias("n"))
    met = matched(classes.select("refs", "n", F.explode("refs").alias("ref")), doc_keys(elements, edges))
    lone, several = met.where(F.size("refs") == 1), met.where(F.size("refs") > 1)
    once = lone.select("element_id", "n").unionByName(several.select("refs", "element_id", "n").distinct().select("element_id", "n"))
    return once.groupBy("element_id").agg(F.sum("n").alias("n"))


def test_matches(refs: DataFrame, elements: DataFrame) -> DataFrame:
    """(owner, element_id), once each: exact, alias and wildcard."""
    return matched(refs, test_keys(elements)).select("owner", "element_id").distinct()


def ambiguous_tokens(elements: DataFrame) -> DataFrame:
    """Last name tokens that occur both with and without a final s, in either form."""
    tokens = T.split_camel(T.last_segment(F.col("id")))
    last = elements.select(F.try_element_at(tokens, F.lit(-1)).alias("token")).where(F.col("token").isNotNull()).distinct()
    single = last.select(F.col("token").alias("single")).where((F.length("single") >= 3))
    pairs = last.join(single, F.col("token") == F.concat("single", F.lit("s"))).where((F.length("token") > 3) & (~F.col("token").endswith("ss") | (F.length("single") > 3)))
    return pairs.select(F.explode(F.array("token", "single")).alias("token")).distinct()


def prefix_collisions(elements: DataFrame) -> DataFrame:
    """(library, token, siblings): names of one token that begin a longer name of their library, with those names."""
    names = elements.select("library", T.split_camel(T.last_segment(F.col("id"))).alias("tokens")).where(F.size("tokens") > 0)
    single = names.where(F.size("tokens") == 1).select("library", F.col("tokens")[0].alias("token")).distinct()
    longer = names.where(F.size("tokens") > 1).select("library", F.col("tokens")[0].alias("token"), F.array_join("tokens", " ").alias("sibling"))
    return single.join(longer, ["library", "token"]).groupBy("library", "token").agg(F.array_sort(F.collect_set("sibling")).alias("siblings"))


def cli_matches(tests: DataFrame, elements: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """(test_id, element_id) of subcommands that a test's name and path tokens name.

    tests has (test_id, path, name_tokens). An element of several tokens may also be named by all of them
    written together. Tests of one path and the same name tokens are judged once, as one case.
    """
    case = F.unhex(F.sha2(F.to_json(F.struct("path", "name_tokens")), 256)).alias("case")
    cases = tests.select("path", "name_tokens").distinct()
    t = cases.select(case, "path", F.transform("name_tokens", F.lower).alias("names"), F.transform(T.path_tokens(F.col("path")), F.lower).alias("paths"))
    if blocked is None:
        t = t.withColumn("tokens", F.array_union(T.stems(F.col("names")), T.stems(F.col("paths"))))
    else:
        # stems first, then forms that the block list names and the test itself doesn't have go
        plain = t.withColumn("own", F.array_union("names", "paths")).withColumn("tokens", F.array_union(T.stems(F.col("names")), T.stems(F.col("paths"))))
        listed = plain.select("case", "own", F.explode("tokens").alias("token"))
        bridged = ~F.array_contains("own", F.col("token"))
        kept = listed.join(shuffled(blocked.select(F.col("token").alias("stop"))), (F.col("token") == F.col("stop")) & bridged, "left_anti")
        t = t.join(shuffled(kept.groupBy("case").agg(F.collect_set("token").alias("tokens"))), "case")
    wide = elements.where(admits(F.col("kind"), "name_tokens") & (F.instr("id", " ") > 0))
    depth = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    forms = wide.select("id", F.lower("library").alias("lib"), F.explode(F.array_union(F.array("id"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("form")).where(depth(F.col("form")) >= depth(F.col("id")))
    forms = forms.withColumn("required", F.filter(T.id_tokens(F.col("form")), lambda x: x != F.col("lib"))).where(F.size("required") > 0)
    # each form starts from its rarest token, so a frequent one never pairs everything; the others are looked up in the test
    owned = t.select("case", F.explode(F.array_distinct("tokens")).alias("token"))
    spread = owned.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    keys = forms.select("id", "form", "required", F.explode(F.array_distinct("required")).alias("key")).join(shuffled(spread), F.col("key") == F.col("token"), "left")
    start = keys.groupBy("id", "form").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("least"), F.first("required").alias("needed")).where("least.n > 0")
    met = owned.join(shuffled(start), F.col("token") == F.col("least.key")).select("case", "id", "form", "needed")
    whole = met.join(shuffled(t.select("case", "tokens")), "case").where(F.size(F.array_except("needed", "tokens")) == 0)
    full = whole.select("case", "id", "form")
    merged = forms.where(F.size("required") >= 2).select("id", "form", F.array_join("required", "").alias("key"))
    joined = owned.join(shuffled(merged), F.col("token") == F.col("key")).select("case", "id", "form")
    pairs = full.unionByName(joined).distinct().join(shuffled(t.select("case", "path", "paths")), "case").join(shuffled(forms), ["id", "form"])

    segment = F.substring_index(F.regexp_replace("form", r" (--|-|<).*$", ""), " ", -1)
    rows = pairs.withColumn("segment", T.id_tokens(segment)).withColumn("own", F.filter("segment", lambda x: x != F.col("lib")))
    base = T.basename(F.col("path"))
    base_tokens = F.array_distinct(lowered_fields(base))
    only_library = F.size("own") == 0
    library_rule = F.array_contains("paths", F.col("lib")) & ((F.size("required") >= 2) | F.exists("required", lambda x: F.array_contains(F.col("paths"), x)))
    same_name = T.alnum_lower(base) == F.array_join("own", "")
    one_word = (F.size(base_tokens) == 1) & F.array_contains(base_tokens, F.try_element_at("own", F.lit(-1)))
    generic = F.lower(base).isin("lib", "mod", "main", "args")
    chain = F.transform(T.dir_chain(F.col("path")), T.alnum_lower)
    wanted = T.alnum_lower(F.array_join("required", ""))
    tails = F.transform(F.sequence(F.lit(1), F.greatest(F.size(chain), F.lit(1))), lambda i: F.array_join(F.slice(chain, i, F.greatest(F.size(chain), F.lit(1))), ""))
    by_dirs = generic & (wanted != "") & F.array_contains(tails, wanted)
    named = rows.where(F.when(only_library, library_rule).otherwise(same_name | one_word | by_dirs)).select("case", F.col("id").alias("element_id")).distinct()
    return tests.select("test_id", case).distinct().join(shuffled(named), "case").select("test_id", "element_id").distinct()


def lowered_fields(s: Column) -> Column:
    return F.filter(F.split(F.lower(s), r"[_\-.]+"), lambda x: x != "")


def unique_local_names(refs: DataFrame, elements: DataFrame) -> DataFrame:
    """References by id, else by a local name (after the last ::) that exactly one element has."""
    local = elements.select("id", F.substring_index("id", "::", -1).alias("local"))
    lone = local.groupBy("local").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("only")).where("n = 1").select("local", "only")
    out = refs.join(elements.select(F.col("id").alias("exact_id")), F.col("ref") == F.col("exact_id"), "left").join(lone, F.substring_index("ref", "::", -1) == F.col("local"), "left")
    return out.select("owner", "ref", F.coalesce("exact_id", "only").alias("element_id")).where(F.col("element_id").isNotNull())
