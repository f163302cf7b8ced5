"""Parsers of test sources. Each yields rows of files.TESTS."""

from __future__ import annotations

import ast
import re
import shlex
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|(?<=[^a-z])(?=[A-Z][a-z])")
_FIDL_REF = re.compile(r"\b((?:[a-z]\w*)(?:::|\.)(?:[a-z]\w*(?:::|\.))*)([A-Z]\w*)(?:::|\.|->)([A-Z]\w*)")


def tokens(name: str) -> list[str]:
    name = re.sub(r"^(Test|Benchmark|Example|Fuzz)", "", name)
    return [p.lower() for part in re.split(r"[ _\-./+,]+", name) for p in _CAMEL.split(part) if p]


def line_of(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


_BRACES = re.compile(r'//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|`[^`]*`|[{}]', re.S)


def braced(text: str, at: int) -> str:
    """The text from the first { after `at` to its partner; braces in comments and strings don't count."""
    start, depth = -1, 0
    for m in _BRACES.finditer(text, at):
        if m[0] == "{":
            start = m.start() if start < 0 else start
            depth += 1
        elif m[0] == "}" and start >= 0:
            depth -= 1
            if depth == 0:
                return text[start : m.end()]
    return text[start:] if start >= 0 else ""


#: Subcommands that a path may hold after its binary. Fixed value.
MAX_DEPTH = 3


def invocation_refs(words: list[str], binary: str) -> list[str]:
    """Command prefixes of two words or more, and the deepest command with each long flag.

    The binary may stand anywhere; the path ends at the first word that isn't a subcommand's name.
    """
    if binary not in words:
        return []
    words = words[words.index(binary) :]
    path = [binary]
    for w in words[1 : MAX_DEPTH + 1]:
        if not re.fullmatch(r"[a-z][a-z0-9-]*", w):
            break
        path.append(w)
    refs = [" ".join(path[:n]) for n in range(2, len(path) + 1)] or [binary]
    flags = [re.match(r"--[a-z][a-z0-9-]*", w) for w in words]
    return refs + [f"{' '.join(path)} {m[0]}" for m in flags if m]


def canonical_invocation(args: list[str], binary: str, valued: frozenset[str] = frozenset(), plain: frozenset[str] = frozenset()) -> tuple[list[str], list[str], bool]:
    """(commands, flags, dynamic) of the literal arguments of a call.

    Global flags before the subcommand, `valued` ones with their value, are taken off and credited to the binary.
    A call without any literal subcommand or global flag is dynamic.
    """
    rest = [a for a in args if a.strip()]
    credited: list[str] = []
    while rest and (m := re.match(r"--([a-z][a-z0-9-]*)(=.*)?$", rest[0])) and m[1] in valued | plain:
        credited.append(f"{binary} --{m[1]}")
        rest = rest[1:]
        if m[1] in valued and not m[2] and rest and not rest[0].startswith("-"):
            rest = rest[1:]
    refs = [r for r in invocation_refs([binary, *rest], binary) if r != binary]
    commands = [r for r in refs if " --" not in r]
    flags = [r for r in refs if " --" in r] if commands else []
    return commands, list(dict.fromkeys(flags + credited)), not commands and not credited


#: Methods of Rust's standard library, which never are calls of a protocol. Fixed values.
RUST_METHODS = frozenset(
    "unwrap expect clone to_string as_str as_ref as_mut into from default new with_capacity push pop len is_empty iter into_iter next collect "
    "map filter fold for_each and_then or_else ok err borrow borrow_mut lock read write send recv spawn await poll ready pending contains insert "
    "remove get set take replace drop as_bytes to_owned clone_from eq hash cmp partial_cmp ne abs min max saturating_add".split()
)


def _camel(name: str) -> str:
    return "".join(p[:1].upper() + p[1:] for p in name.split("_"))


def imported_libraries(text: str, prefix: str) -> list[str]:
    """Protocol libraries below `prefix` that a C++ or Rust source includes or uses."""
    q = re.escape(prefix)
    folders = re.findall(rf'#include\s+[<"]({q}(?:/[a-z0-9_]+)+)/cpp/[a-z]+\.h[>"]', text)
    dotted = re.findall(rf'#include\s+[<"]fidl/({q}\.[a-z0-9.]+)/cpp/[a-z]+\.h[>"]', text)
    used = re.findall(rf"use\s+(?:fidl_)?({q}(?:_[a-z0-9_]+)+)", text)
    return sorted({f.replace("/", ".") for f in folders} | set(dotted) | {u.replace("_", ".") for u in used})


def scoped_calls(body: str, libraries: list[str], rust: bool = False) -> list[str]:
    """What calls on variables may mean in each imported library: the protocol of the variable's name, and any protocol for a method of several words."""
    refs = set()
    for name, method in re.findall(r"\b([a-z][a-z0-9_]*)" + (r"\.([a-z][a-z0-9_]*)" if rust else r"(?:->|\.)([A-Z]\w*)") + r"\s*\(", body):
        name = name if rust else name.rstrip("_")
        if len(name) < 3 or (rust and method in RUST_METHODS):
            continue
        protocol, call = (name[0].upper() + name[1:], _camel(method)) if rust else (_camel(name), method)
        several = re.search(r"[a-z][A-Z]", call)
        refs |= {f"{lib}/{protocol}.{call}" for lib in libraries} | ({f"{lib}/*.{call}" for lib in libraries} if several else set())
    return sorted(refs)


def qualified_refs(body: str) -> list[str]:
    """lib/Protocol.Method of C++ (::) and Rust (::) names."""
    return sorted({f"{lib.rstrip(':.').replace('::', '.')}/{p}.{m}" for lib, p, m in _FIDL_REF.findall(body)})


def bats(files: DataFrame) -> DataFrame:
    """Fully native: one row a @test line."""
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("at", "l"))
    name = F.regexp_extract("l", r"""^\s*@test\s+["']([^"']+)["']\s*\{""", 1)
    rows = lines.withColumn("name", name).where("name <> ''")
    none = F.array().cast("array<string>")
    return rows.select(F.concat_ws("::", "path", "name").alias("test_id"), F.lit("bats").alias("framework"), "name", "path", (F.col("at") + 1).alias("line"), none.alias("name_tokens"), none.alias("refs"))


def gtest(path: str, text: str, macros: tuple[str, ...] = (), idl_prefix: str = "") -> Iterator[dict]:
    scope = imported_libraries(text, idl_prefix) if idl_prefix else []
    pattern = re.compile(r"\b(" + "|".join(("TEST", "TEST_F", "TEST_P", *macros)) + r")\s*\(\s*(\w+)\s*,\s*(\w+)\s*[),]")
    found = list(pattern.finditer(text))
    for m, after in zip(found, [*(x.start() for x in found[1:]), len(text)], strict=True):
        name = f"{m[2]}.{m[3]}"
        pieces = [p.lower() for p in re.split(r"(?<=[a-z])(?=[A-Z])|[._]", name) if p]
        yield {"test_id": name, "framework": "gtest", "name": name, "path": path, "line": line_of(text, m.start()), "name_tokens": pieces, "refs": sorted({*qualified_refs(text[m.end() : after]), *scoped_calls(text[m.end() : after], scope)})}


def protocpp(path: str, text: str, idl_prefix: str = "") -> Iterator[dict]:
    """gtest cases whose refs come from literals, qualified names, and the suite where its namespace matches."""
    space = ".".join(re.findall(r"\bnamespace\s+(\w+)\s*\{", text))
    constants = dict(re.findall(r'constexpr\s+\w[\w:]*\s*(?:\*\s*)?(\w+)(?:\[\])?\s*=\s*"([^"]+)"', text))
    for m in re.finditer(r"\bTEST(?:_F|_P)?\s*\(\s*(\w+)\s*,\s*(\w+)\s*\)", text):
        body = braced(text, m.end())
        literals = re.findall(r'"/?((?:[a-z][\w]*\.)+[A-Z]\w*[/.][A-Z]\w*)"', body)
        named = [v for k, v in constants.items() if re.search(rf"\b{k}\b", body)]
        suite = [f"{space}.{m[1].removesuffix('Test')}"] if idl_prefix and space.startswith(idl_prefix) else []
        name = f"{m[1]}.{m[2]}"
        yield {"test_id": name, "framework": "protocpp", "name": name, "path": path, "line": line_of(text, m.start()), "name_tokens": tokens(m[1]) + tokens(m[2]), "refs": sorted({*literals, *named, *suite, *qualified_refs(body)})}


def gotest(path: str, text: str, binary: str = "") -> Iterator[dict]:
    base = re.sub(r"\.[^./]*$", "", path)
    for m in re.finditer(r"(?m)^func\s+((?:Test|Benchmark|Fuzz|Example)\w*)\s*\(", text):
        body = braced(text, m.end())
        refs: list[str] = []
        if binary:
            for call in re.findall(r"exec\.Command(?:Context)?\(([^)]*)\)", body):
                refs += invocation_refs(re.findall(r'"([^"]*)"', call), binary)
            for args in re.findall(r"(?:SetArgs\(|args\s*:?=\s*)\[\]string\{([^}]*)\}", body):
                refs += invocation_refs([binary, *re.findall(r'"([^"]*)"', args)], binary)
        common = {"framework": "gotest", "path": path, "refs": list(dict.fromkeys(refs))}
        yield common | {"test_id": f"{base}::{m[1]}", "name": m[1], "line": line_of(text, m.start()), "name_tokens": tokens(m[1])}
        for sub in re.finditer(r't\.Run\(\s*"([^"]+)"', body):
            yield common | {"test_id": f"{base}::{m[1]}/{sub[1]}", "name": f"{m[1]}/{sub[1]}", "line": line_of(text, text.find(body) + sub.start()), "name_tokens": tokens(m[1]) + tokens(sub[1])}


def rust_test(path: str, text: str, binary: str = "", idl_prefix: str = "") -> Iterator[dict]:
    scope = imported_libraries(text, idl_prefix) if idl_prefix else []
    module = re.sub(r"\.rs$", "", path).replace("/", "::")
    whole: list[str] = []
    for m in re.finditer(r"#\[(?:\w+::)*test\b[^\]]*\]\s*(?:#\[[^\]]*\]\s*)*(?:pub\s+)?(?:async\s+)?fn\s+(\w+)", text):
        body = braced(text, m.end())
        refs = qualified_refs(body) + scoped_calls(body, scope, rust=True)
        if binary:
            calls = [invocation_refs([binary, *re.findall(r'"([^"]*)"', a)], binary) for a in re.findall(r"&?\[([^\]]*)\]", body)]
            refs += [r for c in calls for r in c if r != binary]
        whole += refs
        yield {"test_id": f"{module}::{m[1]}", "framework": "rust-test", "name": m[1], "path": path, "line": line_of(text, m.start()), "name_tokens": tokens(m[1]), "refs": list(dict.fromkeys(refs))}
    if binary and any(r.startswith(binary + " ") for r in whole):
        yield {"test_id": f"{module}::<{binary}-invocations>", "framework": "rust-test", "name": f"<{binary}-invocations>", "path": path, "line": 1, "name_tokens": [], "refs": sorted({r for r in whole if r.startswith(binary + " ")})}


def pytest_cases(path: str, text: str, prefix: str = "") -> Iterator[dict]:
    """Module functions and methods of outermost test classes; refs are dotted names with the prefix, in both forms."""
    tree = ast.parse(text)
    imported = {a.asname or a.name.split(".")[0]: (f"{n.module}.{a.name}" if isinstance(n, ast.ImportFrom) else a.name) for n in ast.walk(tree) if isinstance(n, (ast.Import, ast.ImportFrom)) for a in n.names}

    def refs(node: ast.AST) -> list[str]:
        names = {n.value for n in ast.walk(node) if isinstance(n, ast.Constant) and isinstance(n.value, str) and prefix and n.value.startswith(prefix)}
        for n in ast.walk(node):
            if isinstance(n, ast.Attribute):
                dotted = ast.unparse(n)
                head, _, rest = dotted.partition(".")
                if head in imported and re.fullmatch(r"[\w.]+", dotted):
                    names.add(f"{imported[head]}.{rest}")
        slashed = {re.sub(r"\.([^.]+)\.([^.]+)$", r"/\1.\2", n) for n in names if n.count(".") >= 2}
        return sorted(names | slashed)

    for node in tree.body:
        inner = node.body if isinstance(node, ast.ClassDef) and node.name.startswith("Test") else [node]
        for f in inner:
            if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)) and f.name.startswith("test"):
                name = f"{node.name}.{f.name}" if isinstance(node, ast.ClassDef) else f.name
                yield {"test_id": f"{path}::{name}", "framework": "pytest", "name": name, "path": path, "line": f.lineno, "name_tokens": tokens(name), "refs": refs(f)}


def python_invocations(path: str, text: str, binary: str = "") -> Iterator[dict]:
    """Command invocations in lists and command strings, by enclosing function; a line scan where Python can't parse."""
    found: dict[str, list[str]] = {}
    try:
        tree = ast.parse(text)
        spans = sorted(((f.lineno, f.end_lineno or f.lineno, f.name) for f in ast.walk(tree) if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef))), key=lambda s: s[1] - s[0])
        for n in ast.walk(tree):
            words = [e.value for e in n.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)] if isinstance(n, (ast.List, ast.Tuple)) else shlex.split(n.value) if isinstance(n, ast.Constant) and isinstance(n.value, str) and n.value.startswith(binary + " ") else []
            if refs := invocation_refs(words, binary):
                owner = next((name for a, b, name in spans if a <= n.lineno <= b), f"<{binary}-invocations>")
                found.setdefault(owner, []).extend(refs)
    except SyntaxError:
        for words in re.findall(rf"\b{re.escape(binary)}((?: [a-z][\w-]*)+)", text):
            found.setdefault(f"<{binary}-invocations>", []).extend(invocation_refs([binary, *words.split()], binary))
    for name, refs in found.items():
        yield {"test_id": f"{path}::{name}", "framework": "python-test", "name": name, "path": path, "line": 1, "name_tokens": tokens(name), "refs": list(dict.fromkeys(refs))}
