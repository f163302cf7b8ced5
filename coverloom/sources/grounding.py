"""Mentions of contract elements in prose, and whether a page ties each one to its element.

A lexicon names elements by surface forms (form, element_id, display, collision, exact). A document is read with
the forms that it may hold: those whose first words, three at most, stand in it. Few forms, by a count against a
bound, go to the workers whole, which look up each document's runs of words; others meet the documents in an equi
join on hashes of these runs, so a lexicon may have any size. Longer forms claim their characters first. Letters
A-Z match in either case, and one final s may follow a form.

Defined cases: null texts and empty forms give nothing; forms without a word character are never found.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.graph import cut
from ..operators.matching import shuffled
from .docs import headings, stack_at

#: Names' last words that are also ordinary English. Fixed values.
COMMON_NOUNS = (
    "node", "service", "manager", "realm", "controller", "channel", "handle", "directory", "file", "server",
    "client", "connection", "event", "object", "resource", "device", "driver", "host", "index", "factory",
    "provider", "registry", "store", "watcher", "listener", "request", "response", "message", "property", "key",
    "value", "entry", "item", "context", "state", "status", "token", "port", "socket", "stream",
    "buffer", "queue", "pool", "task", "job", "worker", "module", "component", "protocol", "interface",
    "capability", "binding", "loader", "runner", "dispatcher", "monitor", "observer",
)
SHORTEST = 3
KEY_WORDS = 3
#: A lexicon of more forms, or more characters in them, is joined.
FEW_FORMS, FEW_CHARS = 1 << 16, 1 << 24
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ASCII = str.maketrans(_UPPER, _LOWER)

_FENCE = re.compile(r"(?ms)^ {0,3}```[\w+-]*\s*\n.*?\n[ \t]*```")
_HEADING = re.compile(r"(?m)^ {0,3}#{1,6}[ \t].*$")
_LINK = re.compile(r"\[([^\]]+)\]\(([^)]+)\)")
_REFERENCE = re.compile(r"\[([^\]]+)\]\[([^\]]*)\]")
_DEFINITION = re.compile(r"(?m)^[ \t]{0,3}\[([^\]]+)\]:[ \t]*(\S+)")
_BRACKET = re.compile(r"\[([^\]]+)\]")
_WORD = re.compile(r"[a-z0-9_]+")
_WORD_BYTES = re.compile(rb"[a-z0-9_]+")

MENTION = (
    "path string, offset int, line int, section array<string>, title string, excerpt string, token string, span int, form string, "
    "qualified boolean, emphasised boolean, targets array<string>, soft boolean"
)


def ascii_lower(s: Column) -> Column:
    return F.translate(s, _UPPER, _LOWER)


def lexicon(elements: DataFrame) -> DataFrame:
    """Surface forms of elements (id, and aliases where there are any): the name, its words apart, a common noun at its end.

    A form that an element has twice keeps the kind of its name.
    """
    names = F.array(F.col("id")) if "aliases" not in elements.columns else F.array_distinct(F.concat(F.array("id"), F.coalesce("aliases", F.array())))
    last = F.regexp_replace("name", r"^.*/(?=.)", "")
    named = elements.select(F.col("id").alias("element_id"), F.regexp_replace("id", r"^.*/(?=.)", "").alias("display"), F.explode(names).alias("name"))
    named = named.select("element_id", "display", ascii_lower(F.trim(last)).alias("whole"), F.transform(F.regexp_extract_all(last, F.lit(r"([A-Z]+(?:[a-z0-9]+)?|[a-z0-9]+)")), ascii_lower).alias("words"))
    nouns = [F.lit(n) for n in COMMON_NOUNS]
    apart, tail = F.array_join("words", " "), F.element_at("words", -1)

    def form(text: Column, collision: Column, exact: bool, where: Column) -> Column:
        return F.when(where, F.struct(text.alias("form"), collision.alias("collision"), F.lit(exact).alias("exact")))

    forms = F.array(
        form(F.col("whole"), F.col("whole").isin(nouns), True, F.lit(True)),
        form(apart, F.lit(False), True, (F.size("words") > 1) & (apart != F.col("whole"))),
        form(tail, F.lit(True), False, (F.size("words") > 0) & tail.isin(nouns) & (tail != F.col("whole"))),
    )
    rows = named.where(F.length("whole") >= SHORTEST).select("element_id", "display", F.explode(F.filter(forms, lambda f: f.isNotNull())).alias("f"))
    best = F.max(F.struct("f.exact", "f.collision")).alias("b")
    return rows.groupBy("element_id", "display", F.col("f.form").alias("form")).agg(best).select("form", "element_id", "display", "b.collision", "b.exact")


def _parts(text: Column) -> Column:
    """The words of a text in lower case, each with what follows it."""
    return F.regexp_extract_all(ascii_lower(text), F.lit(r"([a-z0-9_]+[^a-z0-9_]*)"))


def _run(parts: str, i: Column, width: int) -> Column:
    """`width` words from the i-th on with what stands between them; null past the end."""
    return F.regexp_replace(F.concat(*(F.get(F.col(parts), i + k) for k in range(width))), "[^a-z0-9_]+$", "")


def possible_forms(docs: DataFrame, forms: DataFrame) -> DataFrame:
    """(path, forms): the forms whose first words, three at most, stand in a document."""
    own = forms.select("form").distinct().select("form", _parts(F.col("form")).alias("parts")).where(F.size("parts") > 0)
    first = [F.when(F.size("parts") == w, _run("parts", F.lit(0), w)) for w in range(1, KEY_WORDS)]
    own = own.select("form", F.xxhash64(F.coalesce(*first, _run("parts", F.lit(0), KEY_WORDS))).alias("key"))

    def hashes(run: Column) -> Column:
        return F.when(run.endswith("s"), F.array(F.xxhash64(run), F.xxhash64(F.substring(run, 1, F.length(run) - 1)))).otherwise(F.array(F.xxhash64(run)))

    def at(_: Column, i: Column) -> Column:
        runs = F.filter(F.array(*(_run("parts", i, w) for w in range(1, KEY_WORDS + 1))), lambda r: r.isNotNull())
        return F.flatten(F.transform(runs, hashes))

    # the words are a column of their own, so that they are cut once and not for each run
    split = docs.where(F.col("text").isNotNull()).select("path", _parts(F.col("text")).alias("parts"))
    asked = split.select("path", F.explode(F.array_distinct(F.flatten(F.transform("parts", at)))).alias("key"))
    return asked.join(shuffled(own), "key").groupBy("path").agg(F.collect_set("form").alias("forms"))


def few_forms(forms: DataFrame, most: int = FEW_FORMS) -> list[str] | None:
    """The distinct forms, or None where they are more than `most` or have over FEW_CHARS characters."""
    own = forms.select("form").where(F.col("form").isNotNull()).distinct()
    size = own.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("form")), F.lit(0)).alias("chars")).first()
    return [r.form for r in own.collect()] if size.n <= most and size.chars <= FEW_CHARS else None


def runs_of(forms: list[str]) -> dict[int, dict[tuple[bytes, ...], list[tuple[bytes, str]]]]:
    """By number of words: the first words of forms, three at most, the last also with an s, to (text up to the last word, form)."""
    out: dict[int, dict[tuple[bytes, ...], list[tuple[bytes, str]]]] = {}
    for form in forms:
        low = form.encode().lower()
        first = list(_WORD_BYTES.finditer(low))[:KEY_WORDS]
        if first:
            words, by_words = [m[0] for m in first], out.setdefault(len(first), {})
            for last in (words[-1], words[-1] + b"s"):
                by_words.setdefault((*words[:-1], last), []).append((low[first[0].start() : first[-1].end()], form))
    return out


def _stands(low: bytes, run: bytes) -> bool:
    """Whether a text in lower case holds a run from its first to its last word, or with one final s."""
    at = low.find(run)
    while at >= 0:
        end = at + len(run)
        if not (at and _WORD_BYTES.match(low, at - 1)):
            after = _WORD_BYTES.match(low, end)
            if after is None or after[0] == b"s":
                return True
        at = low.find(run, at + 1)
    return False


def holder(forms: list[str]) -> Callable[[str], list[str]]:
    """A function from a text to those of few forms that possible_forms gives it."""
    runs = runs_of(forms)
    keys = {width: frozenset(by_words) for width, by_words in runs.items()}

    def held(text: str) -> list[str]:
        low = text.encode().lower()
        words, out = _WORD_BYTES.findall(low), set()
        for width, known in keys.items():
            for key in known & set(zip(*(words[k:] for k in range(width)), strict=False)):
                out.update(form for run, form in runs[width][key] if form not in out and _stands(low, run))
        return sorted(out)

    return held


def scan(docs: DataFrame, forms: DataFrame, most: int = FEW_FORMS) -> DataFrame:
    """Mentions of forms (form) in docs (path, text), one row each, with what their place shows: columns MENTION.

    The forms are counted, and joined if they are more than `most`; 0 joins them uncounted.
    """
    schema = pa.schema(
        [
            ("path", pa.string()), ("offset", pa.int32()), ("line", pa.int32()), ("section", pa.list_(pa.string())), ("title", pa.string()),
            ("excerpt", pa.string()), ("token", pa.string()), ("span", pa.int32()), ("form", pa.string()), ("qualified", pa.bool_()),
            ("emphasised", pa.bool_()), ("targets", pa.list_(pa.string())), ("soft", pa.bool_()),
        ]
    )
    few = few_forms(forms, most) if most else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text, listed in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                yield pa.RecordBatch.from_pylist([{"path": path, **m} for m in mentions(text, listed)], schema=schema)

    def run_few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = holder(few)
        for batch in batches:
            for path, text in zip(batch.column(0), batch.column(1), strict=True):
                listed = held(said := text.as_py())
                if listed:
                    yield pa.RecordBatch.from_pylist([{"path": path.as_py(), **m} for m in mentions(said, listed)], schema=schema)

    if few is not None:
        return docs.select("path", "text").where("path is not null and text is not null").mapInArrow(run_few, MENTION)
    held = docs.select("path", "text").join(shuffled(possible_forms(docs, forms)), "path")
    return held.select("path", "text", "forms").mapInArrow(run, MENTION)


def _lower(s: str) -> str:
    """Letters A-Z in lower case, others as they are."""
    return s.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def claims(text: str, forms: list[str]) -> list[tuple[int, int, str]]:
    """(start, end, form) of the forms in prose: forms of more words first, then longer ones, then by name; no character twice."""
    prose = _lower(text)
    for blank in (_FENCE, _HEADING):
        prose = blank.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), prose)
    by_word: dict[str, list[tuple[int, str, str]]] = {}
    for form in forms:
        low = _lower(form)
        first = _WORD.search(low)
        if first:
            by_word.setdefault(first[0], []).append((first.start(), low, form))
    found = []
    for word in _WORD.finditer(prose):
        w = word[0]
        for lead, low, form in by_word.get(w, []) + (by_word.get(w[:-1], []) if w.endswith("s") else []):
            start = word.start() - lead
            if start < 0 or not prose.startswith(low, start) or (start and _WORD.match(prose[start - 1])):
                continue
            end = start + len(low)
            if prose[end : end + 1] == "s" and not _WORD.match(prose[end + 1 : end + 2]):
                end += 1
            if not _WORD.match(prose[end : end + 1]):
                found.append((-low.count(" "), -len(low), low, start, end, form))
    taken = bytearray(len(prose) + 1)
    out = []
    for _, size, _, start, end, form in sorted(found):
        if not any(taken[start : start - size]):
            taken[start : start - size] = b"\x01" * -size
            out.append((start, end, form))
    return sorted(out)


def _sentence(text: str, at: int) -> tuple[int, int]:
    """The sentence around a place: it ends at . ! ? before white space and at empty lines."""
    start = at
    while start and not (text[start - 2 : start] == "\n\n" or (text[start - 1] in ".!?" and text[start] in " \t\n\r")):
        start -= 1
    while start < at and text[start] in " \t\n\r":
        start += 1
    end = re.compile(r"\n\n|[.!?](?=[ \t\n\r]|\Z)").search(text, at)
    return start, len(text) if end is None else end.start() if end[0] == "\n\n" else end.end()


def _qualified(text: str, start: int, end: int, line: tuple[int, int], token: str, common_start: bool) -> bool:
    """Code on its line, or a capital that isn't a sentence's first common word, or part of a qualified name."""
    left, right = text[line[0] : start], text[end : line[1]]
    if left.endswith("`") or right.startswith("`") or ("`" in left and "`" in right):
        return True
    if not "A" <= token[:1] <= "Z":
        return False
    if not common_start:
        return True
    return bool(re.search(r"(?:[./]|::)\Z", text[max(0, start - 2) : start]) or re.match(r"[./][A-Z]|::", text[end : end + 2]))


def _targets(text: str, line: tuple[int, int], at: int, defined: dict[str, str]) -> list[str]:
    """Tails of the targets of links around a place of a line: the fragment, else the last part without extension."""
    row, out = text[line[0] : line[1]], []
    for m in _LINK.finditer(row):
        if m.start(1) <= at < m.end(1):
            out.append(m[2])
    for m in _REFERENCE.finditer(row):
        if m.start(1) <= at < m.end(1):
            out.append(defined.get(_label(m[2]) or _label(m[1]), ""))
    tails = []
    for target in out:
        low = target.translate(_ASCII)
        if "#" in low:
            low = low.rpartition("#")[2]
        elif "/" in low:
            low = low.rpartition("/")[2]
            low = low.rpartition(".")[0] if "." in low else low
        tails.append(low)
    return [t for t in tails if t]


def _label(s: str) -> str:
    return " ".join(s.lower().split())


def mentions(text: str, forms: list[str]) -> Iterator[dict]:
    """What stands around each mention of a document."""
    above = headings(text)
    title = next((t for _, level, t in above if level == 1), "")
    defined: dict[str, str] = {}
    for m in _DEFINITION.finditer(text):
        defined.setdefault(_label(m[1]), m[2])
    nouns, number, counted = set(COMMON_NOUNS), 1, 0
    for start, end, form in claims(text, forms):
        number, counted = number + text.count("\n", counted, start), start
        line = (text.rfind("\n", 0, start) + 1, (text.find("\n", end) + 1 or len(text) + 1) - 1)
        first, last = _sentence(text, start)
        token = text[start:end]
        low = token.translate(_ASCII)
        initial = first == start and "A" <= token[:1] <= "Z" and (low in nouns or low.removesuffix("s") in nouns)
        inside = any(m.start(1) <= start - line[0] < m.end(1) for m in _BRACKET.finditer(text[line[0] : line[1]]))
        yield {
            "offset": start,
            "line": number,
            "section": stack_at(above, start),
            "title": title,
            "excerpt": text[first:last].strip(),
            "token": token,
            "span": start - first,
            "form": form,
            "qualified": _qualified(text, start, end, line, token, initial),
            "emphasised": (text[start - 1 : start] in ("*", "_") and text[end : end + 1] in ("*", "_") and start > 0) or (start > 1 and text[start - 2 : start] == "**"),
            "targets": _targets(text, line, start - line[0], defined),
            "soft": initial or inside,
        }


def _names(text: Column, form: Column) -> Column:
    """Whether a text holds a form as a whole word, or with one final s."""
    return F.regexp_like(ascii_lower(text), F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), form, F.lit(r"\Es?(?![A-Za-z0-9_])")))


def findings(docs: DataFrame, forms: DataFrame, suppressed: DataFrame | None = None) -> DataFrame:
    """One row for each mention: its element, competing elements, anchors, state, severity and fix.

    forms is a lexicon. The element is the owner whose whole name the token is, else the first by id; an owner is
    bound in a section (the headings above) by any qualified, linked or emphasised mention there. Confirmed
    mentions are GROUNDED; a title or heading that names the element, or a weak hint, makes GUESSING; the rest are
    UNGROUNDED. `suppressed` has (path, token, element_id): token * stands for all, a null element for any.
    """
    # a lexicon has a form and more for each element
    hits = cut(scan(docs, forms, most=0).withColumn("place", F.array_join("section", "›")))
    owners = forms.groupBy("form").agg(
        F.min("element_id").alias("lowest"),
        F.min(F.when(F.col("exact"), F.col("element_id"))).alias("named"),
        F.count_distinct("element_id").alias("competing"),
        F.max("collision").alias("collision"),
        F.max("exact").alias("exact"),
        F.max(~F.col("exact")).alias("tail"),
    )
    whole = F.regexp_replace(ascii_lower(F.col("token")), "s$", "") == ascii_lower(F.col("form"))
    rows = hits.join(shuffled(owners), "form").withColumn("element_id", F.when(whole, F.coalesce("named", "lowest")).otherwise(F.col("lowest")))
    if suppressed is not None:
        rows = rows.join(suppressed.where("token = '*'").select("path").distinct(), "path", "left_anti")
        named = suppressed.where("token <> '*'").select(F.col("path").alias("p"), ascii_lower(F.col("token")).alias("t"), F.col("element_id").alias("e"))
        own = (F.col("path") == F.col("p")) & (ascii_lower(F.col("token")) == F.col("t"))
        rows = rows.join(named.where("e is null"), own, "left_anti").join(named.where("e is not null"), own & (F.col("element_id") == F.col("e")), "left_anti")

    # what binds an element in a section or names it above: mentions of any of the element's forms count
    listed = forms.select("element_id", "display", F.col("form").alias("own"))
    wanted = rows.select("path", "place", "element_id", "title", "section").distinct().join(shuffled(listed), "element_id")
    shown = hits.join(shuffled(owners.select("form", "exact")), "form").groupBy("path", "place", F.col("form").alias("own")).agg(
        F.max("qualified").alias("qualified"), F.max(F.col("emphasised") & F.col("exact")).alias("defined"), F.array_distinct(F.flatten(F.collect_set("targets"))).alias("targets")
    )
    linked = F.exists("targets", lambda t: F.regexp_like(t, F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), ascii_lower(F.col("display")), F.lit(r"\E(?![A-Za-z0-9_])"))))
    bound = wanted.join(shuffled(shown), ["path", "place", "own"], "left").groupBy("path", "place", "element_id", "display").agg(
        F.coalesce(F.max("qualified"), F.lit(False)).alias("by_name"),
        F.coalesce(F.max("defined"), F.lit(False)).alias("by_term"),
        F.coalesce(F.max(linked), F.lit(False)).alias("by_link"),
        F.max(_names(F.col("title"), F.col("own"))).alias("in_title"),
        F.max(F.exists("section", lambda h: _names(h, F.col("own")))).alias("in_heading"),
    )
    begins = hits.groupBy("path", F.col("form").alias("own")).agg(F.min("offset").alias("begin"))
    earliest = rows.select("path", "element_id").distinct().join(shuffled(listed), "element_id").join(shuffled(begins), ["path", "own"]).groupBy("path", "element_id").agg(F.min("begin").alias("begin"))
    dense = hits.groupBy("path", "place").agg(F.count(F.lit(1)).alias("density"))

    rows = rows.join(shuffled(bound), ["path", "place", "element_id"]).join(shuffled(earliest), ["path", "element_id"]).join(shuffled(dense), ["path", "place"])
    plain_name = F.col("exact") & ~F.col("collision")
    rows = rows.withColumn("first_use", (F.col("offset") == F.col("begin")) & (plain_name | F.col("qualified")))
    rows = rows.withColumn("state", state(plain_name | F.col("first_use") | F.col("by_name") | F.col("by_term") | F.col("by_link"), F.col("in_title") | F.col("in_heading") | F.col("soft") | (F.col("tail") & ~F.col("exact"))))
    severity = F.floor(T.grounding_severity(F.col("state"), F.col("competing"), F.col("density")) * 100 + F.lit(0.5)) / 100
    fix = F.when(F.col("state") == "GUESSING", "define_term").when(F.col("state") == "UNGROUNDED", "link_first_use")
    checked = F.struct(
        F.col("in_title").alias("page_title"), F.col("in_heading").alias("heading"), "first_use",
        F.col("by_term").alias("defined_term"), F.col("by_name").alias("qualified_mention"), F.col("by_link").alias("link"),
    )
    return rows.select("path", "offset", "line", "section", "excerpt", "token", "span", "element_id", "display", "competing", "collision", checked.alias("checked"), "state", severity.alias("severity"), fix.alias("fix"))


def state(confirmed: Column, hinted: Column) -> Column:
    return F.when(confirmed, "GROUNDED").when(hinted, "GUESSING").otherwise("UNGROUNDED")


def elements_found(forms: DataFrame, found: DataFrame) -> DataFrame:
    """Every element of a lexicon with its mentions by state and its best state."""
    counted = found.groupBy("element_id").agg(*(F.count_if(F.col("state") == s).alias(s.lower()) for s in ("GROUNDED", "GUESSING", "UNGROUNDED")))
    rows = forms.select("element_id", "display").distinct().join(shuffled(counted), "element_id", "left").fillna(0, ["grounded", "guessing", "ungrounded"])
    best = F.when(F.col("grounded") > 0, "GROUNDED").when(F.col("guessing") > 0, "GUESSING").when(F.col("ungrounded") > 0, "UNGROUNDED").otherwise("NOT_MENTIONED")
    return rows.withColumn("state", best)


def report_json(forms: DataFrame, found: DataFrame) -> DataFrame:
    """(part, id, json): a row for each finding and each element, and one summary."""
    known = elements_found(forms, found)
    of = lambda df, part, key: df.select(F.lit(part).alias("part"), key.alias("id"), F.to_json(F.struct(*df.columns)).alias("json"))
    total = known.agg(
        F.count(F.lit(1)).alias("elements_total"),
        F.count_if(F.col("state") != "NOT_MENTIONED").alias("elements_mentioned"),
        *(F.coalesce(F.sum(s), F.lit(0)).alias(f"references_{s}") for s in ("grounded", "guessing", "ungrounded")),
    ).withColumn("forces_a_guess", F.col("references_guessing") + F.col("references_ungrounded"))
    place = F.concat_ws(":", "path", F.lpad(F.col("offset").cast("string"), 10, "0"))
    return of(found, "finding", place).unionByName(of(known, "element", F.col("element_id"))).unionByName(of(total, "summary", F.lit("")))
