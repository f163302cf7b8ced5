"""Parsers of contract sources. Each yields rows of files.ELEMENTS."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from .tests import braced, line_of


def kebab(s: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "-", s).replace("_", "-").lower()


def element(id_: str, kind: str, ecosystem: str, library: str, path: str, line: int = 0, **more: object) -> dict:
    return {"id": id_, "kind": kind, "ecosystem": ecosystem, "library": library, "path": path, "line": line, "aliases": [], "edges": [], "doc": "", "type": "", "default_value": ""} | more


def _comment_above(text: str, at: int, mark: str = "///") -> str:
    lines, out = text[:at].rstrip(" \t").split("\n")[:-1], []
    while lines and (lines[-1].strip().startswith(mark) or lines[-1].strip().startswith(("@", "#["))):
        line = lines.pop().strip()
        if line.startswith(mark):
            out.append(line.removeprefix(mark).strip())
    return " ".join(reversed(out))


def fidl(path: str, text: str) -> Iterator[dict]:
    """Protocols, methods and types of one library, with composition and parameter edges."""
    library = m[1] if (m := re.search(r"(?m)^\s*library\s+([\w.]+)\s*;", text)) else ""
    if re.search(r"@available\([^)]*\)\s*library", text):
        yield element(library, "LIBRARY", "fidl", library, path, 1)
    for m in re.finditer(r"(?m)^\s*(?:closed|open|ajar)?\s*protocol\s+(\w+)\s*\{", text):
        body, name = braced(text, m.start()), m[1]
        composed = [c if "." not in c else re.sub(r"\.(\w+)$", r"/\1", c) for c in re.findall(r"\bcompose\s+([\w.]+)\s*;", body)]
        yield element(f"{library}/{name}", "PROTOCOL", "fidl", library, path, line_of(text, m.start(1)), doc=_comment_above(text, m.start()), edges=[{"kind": "COMPOSED_FROM", "target": c if "/" in c else f"{library}/{c}"} for c in composed])
        for f in re.finditer(r"(?m)^\s*(?:flexible|strict)?\s*(->)?\s*(\w+)\s*\(([^)]*)\)\s*(?:->\s*\(([^)]*)\))?", body):
            if f[2] in ("available", "struct", "table"):
                continue
            used = [("ACCEPTS", f[3] or ""), ("RETURNS", f[4] or "")]
            edges = [{"kind": k, "target": f"{library}/{t}"} for k, part in used for t in re.findall(r"\b([A-Z]\w*)\b", part)]
            yield element(f"{library}/{name}.{f[2]}", "METHOD", "fidl", library, path, line_of(text, text.find(body) + f.start(2)), doc=_comment_above(body, f.start(2)), aliases=[f"{library}.{name}.{f[2]}"], edges=edges)
    for m in re.finditer(r"(?m)^\s*(?:type|const|alias)\s+(\w+)", text):
        yield element(f"{library}/{m[1]}", "TYPE", "fidl", library, path, line_of(text, m.start(1)), doc=_comment_above(text, m.start()))


def proto(path: str, text: str) -> Iterator[dict]:
    """Services, methods and top-level messages of a .proto file."""
    package = m[1] if (m := re.search(r"(?m)^\s*package\s+([\w.]+)\s*;", text)) else ""
    for m in re.finditer(r"(?m)^service\s+(\w+)\s*\{", text):
        body, name = braced(text, m.start()), m[1]
        yield element(f"{package}/{name}", "PROTOCOL", "proto", package, path, line_of(text, m.start()), doc=_comment_above(text, m.start(), "//"), aliases=[f"{package}.{name}"])
        for f in re.finditer(r"rpc\s+(\w+)\s*\(\s*(stream\s+)?([\w.]+)\s*\)\s*returns\s*\(\s*(stream\s+)?([\w.]+)\s*\)", body):
            edges = [{"kind": k, "target": f"{package}/{t}"} for k, t in (("ACCEPTS", f[3]), ("RETURNS", f[5])) if "." not in t]
            doc = _comment_above(body, f.start(), "//") or f"rpc {f[1]}({f[2] or ''}{f[3]}) returns ({f[4] or ''}{f[5]})"
            yield element(f"{package}/{name}.{f[1]}", "METHOD", "proto", package, path, line_of(text, text.find(body) + f.start()), doc=doc, aliases=[f"{package}.{name}.{f[1]}"], edges=edges)
    for m in re.finditer(r"(?m)^(?:message|enum)\s+(\w+)", text):
        yield element(f"{package}/{m[1]}", "TYPE", "proto", package, path, line_of(text, m.start()), doc=_comment_above(text, m.start(), "//"))


def cobra(path: str, text: str) -> Iterator[dict]:
    """One command's YAML: the command and its options; boolean options are switches."""
    import yaml

    doc = yaml.safe_load(text) or {}
    command = doc.get("command") or re.sub(r"\.ya?ml$", "", path.rsplit("/", 1)[-1]).replace("_", " ")
    library = command.split(" ")[0]
    aliases = [a.strip() for a in (doc.get("aliases") or "").split(",") if a.strip()] if isinstance(doc.get("aliases"), str) else list(doc.get("aliases") or [])
    yield element(command, "SUBCOMMAND", "cli", library, path, 1, doc=doc.get("short") or doc.get("long") or "", aliases=aliases)
    for o in sorted(doc.get("options") or [], key=lambda o: o["option"]):
        kind = "SWITCH" if o.get("value_type") == "bool" else "FLAG"
        yield element(f"{command} --{o['option']}", kind, "cli", library, path, 1, doc=o.get("description") or "", type=o.get("value_type") or "", default_value=str(o.get("default_value") or ""), aliases=[f"{a} --{o['option']}" for a in aliases])


def _rust_fields(body: str) -> Iterator[tuple[str, str, str, str]]:
    """(attributes, doc, field, type) of a struct body."""
    for m in re.finditer(r"((?:\s*(?:///[^\n]*\n|#\[[^\]]*\]))*)\s*(?:pub\s+)?(\w+)\s*:\s*([^,\n]+),?", body):
        yield " ".join(re.findall(r"#\[([^\]]*)\]", m[1])), " ".join(re.findall(r"///\s?([^\n]*)", m[1])), m[2], m[3].strip()


def clap(path: str, text: str, binary: str = "") -> Iterator[dict]:
    """Derived Rust command lines: the parser, its subcommands, and their arguments."""
    structs = {m[2]: (m[1], braced(text, m.end())) for m in re.finditer(r"((?:#\[[^\]]*\]\s*|///[^\n]*\s*)*)(?:pub\s+)?(?:struct|enum)\s+(\w+)", text)}
    root = next((n for n, (a, _) in structs.items() if re.search(r"derive\([^)]*\bParser\b", a)), None)
    if root is None:
        return
    named = re.search(r'name\s*=\s*"([^"]+)"', structs[root][0])
    yield from _clap_command(path, text, structs, root, binary or (named[1] if named else kebab(root)))


def _clap_command(path: str, text: str, structs: dict, name: str, command: str, seen: tuple[str, ...] = ()) -> Iterator[dict]:
    attributes, body = structs[name]
    library = command.split(" ")[0]
    yield element(command, "SUBCOMMAND", "cli", library, path, line_of(text, max(0, text.find(f" {name}"))), doc=" ".join(re.findall(r"///\s?([^\n]*)", attributes)))
    yield from _clap_fields(path, text, structs, body, command, (*seen, name))


def _clap_fields(path: str, text: str, structs: dict, body: str, command: str, seen: tuple[str, ...]) -> Iterator[dict]:
    library = command.split(" ")[0]
    for attrs, doc, field, kind in _rust_fields(body[1:-1]):
        inner = re.sub(r"^(?:Option|Vec|Box)<(.*)>$", r"\1", kind)
        if "hide = true" in attrs or inner in seen:
            continue
        if re.search(r"\bflatten\b", attrs) and inner in structs:
            yield from _clap_fields(path, text, structs, structs[inner][1], command, (*seen, inner))
        elif re.search(r"\bsubcommand\b", attrs) and inner in structs:
            for m in re.finditer(r"(?m)^\s*((?:///[^\n]*\n\s*|#\[[^\]]*\]\s*)*)(\w+)\s*(?:\((\w+)\)|\{)?", structs[inner][1][1:-1]):
                renamed = re.search(r'name\s*=\s*"([^"]+)"', m[1])
                child = f"{command} {renamed[1] if renamed else kebab(m[2])}"
                if m[3] in structs and m[3] not in seen:
                    yield from _clap_command(path, text, structs, m[3], child, (*seen, inner))
                elif m[2][:1].isupper():
                    yield element(child, "SUBCOMMAND", "cli", library, path, 1, doc=" ".join(re.findall(r"///\s?([^\n]*)", m[1])))
        else:
            long = re.search(r'\blong\b(?:\s*=\s*"([^"]+)")?', attrs)
            short = re.search(r"\bshort\b(?:\s*=\s*'(\w)')?", attrs)
            default = re.search(r'default_value(?:_t)?\s*=\s*"?([^",)]+)', attrs)
            if not long and not short:
                yield element(f"{command} <{field}>", "POSITIONAL", "cli", library, path, 1, doc=doc, type=kind)
                continue
            flag = "--" + ((long[1] if long and long[1] else None) or kebab(field))
            of = "SWITCH" if kind == "bool" else "CONFIG_KNOB" if default else "FLAG"
            bare = [flag] + ([f"-{short[1] or field[0]}"] if short else [])
            yield element(f"{command} {flag}", of, "cli", library, path, 1, doc=doc, type=kind, default_value=default[1] if default else "", aliases=bare)


def argh(path: str, text: str) -> Iterator[dict]:
    for m in re.finditer(r"#\[derive\([^)]*\bFromArgs\b[^)]*\)\]\s*#\[argh\(([^\]]*)\)\]\s*((?:///[^\n]*\s*)*)(?:pub\s+)?struct\s+(\w+)", text):
        named = re.search(r'name\s*=\s*"([^"]+)"', m[1])
        command = named[1] if named else kebab(m[3])
        library = command.rsplit(" ", 1)[0]
        yield element(command, "SUBCOMMAND", "cli", library, path, line_of(text, m.start()), doc=" ".join(re.findall(r"///\s?([^\n]*)", m[2])))
        for attrs, doc, field, kind in _rust_fields(braced(text, m.end())[1:-1]):
            renamed = re.search(r'long\s*=\s*"([^"]+)"', attrs)
            if "positional" in attrs:
                yield element(f"{command} <{field}>", "POSITIONAL", "cli", library, path, 1, doc=doc, type=kind)
            elif "switch" in attrs or "option" in attrs:
                default = re.search(r'default\s*=\s*"((?:\\.|[^"\\])*)"', attrs)
                of = "SWITCH" if "switch" in attrs else "CONFIG_KNOB" if default else "FLAG"
                yield element(f"{command} --{renamed[1] if renamed else kebab(field)}", of, "cli", library, path, 1, doc=doc, type=kind, default_value=_rust_literal(default[1]) if default else "")


def _rust_literal(code: str) -> str:
    """The text of a quoted string that the expression begins with, else the expression."""
    m = re.match(r'\\"((?:[^"\\]|\\[^"])*)\\"', code)
    return m[1] if m else code


def cml(path: str, text: str) -> Iterator[dict]:
    """Configuration keys of a component manifest."""
    m = re.search(r"\bconfig\s*:\s*\{", text)
    folder = path.rsplit("/", 2)[-2] if "/" in path else ""
    for k in re.finditer(r"(\w+)\s*:\s*(\{[^}]*\}|[^,\n{}]+)", braced(text, m.start())[1:-1] if m else ""):
        value = k[2].strip()
        kind = t[1] if (t := re.search(r"type\s*:\s*[\"'](\w+)", value)) else "unknown"
        default = t[1] if (t := re.search(r"default\s*:\s*[\"']?([^,\"'}\s]+)", value)) else "" if value.startswith("{") else value.strip("\"'")
        yield element(f"cml:{folder}/{k[1]}", "CONFIG_KNOB", "cml", folder, path, line_of(text, text.find(k[0])), type=kind, default_value=default)


def _schema_rows(schema: dict, prefix: str, make, above: tuple[int, ...] = ()) -> Iterator[dict]:  # noqa: ANN001
    """The properties of a schema at every depth; an alias that leads back to a schema above isn't followed again."""
    for name, s in sorted((schema.get("properties") or {}).items()):
        at = f"{prefix}.{name}"
        meta = ",".join(str(x) for x in (s.get("type"), s.get("format"), "|".join(map(str, s.get("enum", [])))) if x)
        yield make(at, meta, s)
        inner = s
        while inner.get("type") == "array" and isinstance(inner.get("items"), dict) and inner["items"] is not inner:
            inner, at = inner["items"], at + "[]"
        if id(inner) not in above:
            yield from _schema_rows(inner, at, make, (*above, id(inner)))


def _yaml_loader() -> type:
    """libyaml's loader, which is several times as fast; the one in Python where PyYAML comes without it."""
    import yaml

    return getattr(yaml, "CSafeLoader", yaml.SafeLoader)


def _yaml(text: str) -> object:
    import yaml

    return yaml.load(text, Loader=_yaml_loader())  # noqa: S506  a safe loader


def _yaml_all(text: str) -> Iterator:
    import yaml

    return yaml.load_all(text, Loader=_yaml_loader())  # noqa: S506  a safe loader


def crd(path: str, text: str) -> Iterator[dict]:
    for doc in _yaml_all(text):
        if not doc or doc.get("kind") != "CustomResourceDefinition":
            continue
        spec = doc["spec"]
        group, kind = spec["group"], spec["names"]["kind"]
        several = len(spec.get("versions", [])) > 1
        yield element(group, "LIBRARY", "crd", group, path, 1)
        for v in spec.get("versions", []):
            base = f"{group}/{kind}" + (f"@{v['name']}" if several else "")
            schema = (v.get("schema") or {}).get("openAPIV3Schema") or {}
            yield element(base, "TYPE", "crd", group, path, 1, doc=schema.get("description", ""))
            yield from _schema_rows(schema, base, lambda at, meta, s: element(at, "CONFIG_KNOB", "crd", group, path, 1, doc=s.get("description", ""), type=meta, default_value="" if s.get("default") is None else json.dumps(s["default"])))


def k8smanifest(path: str, text: str) -> Iterator[dict]:
    import yaml

    seen: set[str] = set()
    for part in re.split(r"(?m)^---\s*$", text):
        if "{{" in part:
            continue
        try:
            doc = _yaml(part)
        except yaml.YAMLError:
            continue
        if not isinstance(doc, dict) or not doc.get("apiVersion") or not doc.get("kind"):
            continue
        group = doc["apiVersion"].split("/")[0] if "/" in doc["apiVersion"] else "core"
        base = f"{group}/{doc['kind']}"
        rows = [element(group, "LIBRARY", "manifest", group, path, 1), element(base, "TYPE", "manifest", group, path, 1)]
        body = {k: v for k, v in doc.items() if k not in ("apiVersion", "kind", "metadata", "status")}
        rows += [element(f"{base}.{k}", "CONFIG_KNOB", "manifest", group, path, 1, default_value="" if isinstance(v, (dict, list)) else json.dumps(v)) for k, v in _leaves(body)]
        for r in rows:
            if r["id"] not in seen:
                seen.add(r["id"])
                yield r


def _leaves(value: object, at: str = "") -> Iterator[tuple[str, object]]:
    if isinstance(value, dict):
        for k, v in value.items():
            here = f"{at}.{k}" if at else str(k)
            yield here, v
            yield from _leaves(v, here)
    elif isinstance(value, list):
        for v in value:
            yield from _leaves(v, at + "[]")


def helm_schema(path: str, text: str) -> Iterator[dict]:
    chart = path.rsplit("/", 2)[-2] if "/" in path else "chart"
    root = json.loads(text)

    def resolve(s: dict, seen: tuple[str, ...] = ()) -> dict:
        ref = s.get("$ref", "")
        if ref.startswith("#/$defs/") and ref not in seen:
            return resolve(root.get("$defs", {}).get(ref.removeprefix("#/$defs/"), {}), (*seen, ref)) | {k: v for k, v in s.items() if k != "$ref"}
        out = dict(s)
        if "properties" in out:
            out["properties"] = {k: resolve(v, seen) for k, v in out["properties"].items()}
        return out

    rows = list(_schema_rows(resolve(root), chart, lambda at, meta, s: element(at, "CONFIG_KNOB", "helm", chart, path, 1, doc=s.get("description", ""), type=meta, default_value="" if s.get("default") is None else json.dumps(s["default"]))))
    if rows:
        yield element(chart, "LIBRARY", "helm", chart, path, 1)
    yield from rows


def helm_values(path: str, text: str) -> Iterator[dict]:
    """values.yaml with the comment above each key as its text."""
    import yaml

    chart = path.rsplit("/", 2)[-2] if "/" in path else "chart"
    rows = [(k, v) for k, v in _leaves(yaml.safe_load(text) or {})]
    lines = text.split("\n")
    docs = {m[1]: lines[i - 1].strip().lstrip("# -") for i, line in enumerate(lines) if i and (m := re.match(r"\s*([\w-]+):", line)) and lines[i - 1].strip().startswith("#")}
    if rows:
        yield element(chart, "LIBRARY", "helm", chart, path, 1)
    for k, v in rows:
        yield element(f"{chart}.{k}", "CONFIG_KNOB", "helm", chart, path, 1, doc=docs.get(k.rsplit(".", 1)[-1], ""), default_value="" if isinstance(v, (dict, list)) else json.dumps(v))


def cppheader(path: str, text: str, module: str = "") -> Iterator[dict]:
    """Public classes, methods, free functions, enums and macros; anonymous namespaces and guards are skipped."""
    module = module or (path.split("/")[0] if "/" in path else "")
    clean = re.sub(r"/\*.*?\*/", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)
    for m in re.finditer(r"(?m)^[ \t]*#define[ \t]+(\w+)", clean):
        if not re.search(r"_H(PP)?_?$", m[1]):
            yield element(f"{module}/{m[1]}", "CPP_MACRO", "cpp", module, path, line_of(text, m.start()))
    stack: list[tuple[str, str, bool]] = []  # (kind, name, public)
    statement, begun = "", 0
    for i, c in enumerate(re.sub(r"//[^\n]*|(?m:^[ \t]*#(?:[^\n\\]|\\.)*)", lambda m: " " * len(m[0]), clean)):
        if c == "{":
            yield from _cpp_open(statement, stack, module, path, line_of(text, begun))
            statement = ""
        elif c == "}":
            if stack:
                stack.pop()
            statement = ""
        elif c == ";":
            yield from _cpp_function(statement, stack, module, path, line_of(text, begun))
            statement = ""
        elif c == ":" and re.fullmatch(r"\s*(public|private|protected)", statement) and stack:
            stack[-1] = (stack[-1][0], stack[-1][1], "public" in statement)
            statement = ""
        else:
            begun = i if not statement.strip() else begun
            statement += c


def _cpp_name(stack: list[tuple[str, str, bool]], name: str) -> str:
    return "::".join([n for _, n, _ in stack if n] + [name])


def _cpp_open(statement: str, stack: list, module: str, path: str, line: int) -> Iterator[dict]:
    hidden = any(k in ("hidden", "body") for k, _, _ in stack) or bool(stack and not stack[-1][2])
    if m := re.search(r"\bnamespace\s*([\w:]*)\s*$", statement):
        stack.append(("namespace" if m[1] else "hidden", m[1], True))
    elif m := re.search(r"\benum\s+(?:class\s+|struct\s+)?(\w+)", statement):
        if not hidden:
            yield element(f"{module}/{_cpp_name(stack, m[1])}", "TYPE", "cpp", module, path, line)
        stack.append(("body", "", False))
    elif (m := re.search(r"\b(class|struct)\s+(?:\w+\([^)]*\)\s*)?(?:\[\[[^\]]*\]\]\s*)?(\w+)\s*(?:final\s*)?(?::[^;]*)?$", statement)) and "(" not in statement.split(m[1])[0]:
        if not hidden:
            bases = re.findall(r"public\s+([\w:]+)", statement)
            yield element(f"{module}/{_cpp_name(stack, m[2])}", "CPP_CLASS", "cpp", module, path, line, edges=[{"kind": "EXTENDS", "target": b} for b in bases])
        stack.append(("class", m[2], m[1] == "struct" and not hidden))
    else:
        yield from _cpp_function(statement, stack, module, path, line)
        stack.append(("body", "", False))


def _cpp_function(statement: str, stack: list, module: str, path: str, line: int) -> Iterator[dict]:
    if any(k in ("hidden", "body") for k, _, _ in stack) or (stack and not stack[-1][2]):
        return
    m = re.search(r"([A-Za-z_]\w*)\s*\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?:const|noexcept|override|final|=\s*0|=\s*default|->\s*[\w:<>]+|:\s*.*|\s)*$", statement, re.S)
    if not m or "=" in statement[: m.start()] or re.search(r"\b(return|using|typedef|friend|delete|operator|if|for|while)\b", statement) or "= delete" in statement:
        return
    owner = stack[-1][1] if stack and stack[-1][0] == "class" else ""
    if owner and m[1] == owner.lstrip("~"):
        return
    if statement[: m.start()].strip() or owner:
        yield element(f"{module}/{_cpp_name(stack, m[1])}", "METHOD" if owner else "CPP_FREE_FUNCTION", "cpp", module, path, line)


def implements_map(path: str, text: str) -> Iterator[dict]:
    """C++ and Rust classes that implement a protocol's server, with their edges."""
    found: dict[str, set[str]] = {}
    for m in re.finditer(r"\bclass\s+(\w+)\s*(?:final\s*)?:\s*([^{;]*)\{", text):
        for lib, p in re.findall(r"(?:fidl::(?:Wire)?Server|WireServer|Server)<\s*([\w:]+)::(\w+)\s*>", m[2]):
            found.setdefault(m[1], set()).add(f"{lib.replace('::', '.').replace('_', '.')}/{p}")
    for lib, p, name in re.findall(r"impl\s+([\w:]+)::(\w+?)(?:RequestHandler|Server)?\s+for\s+(\w+)", text):
        found.setdefault(name, set()).add(f"{lib.replace('::', '.')}/{p}")
    for name, targets in found.items():
        yield element(f"cpp:{path}#{name}", "CPP_CLASS", "cpp", "", path, 1, edges=[{"kind": "IMPLEMENTS", "target": t} for t in sorted(targets)])


def facades(path: str, text: str) -> Iterator[dict]:
    """Facade and backend targets of a build file; a backend's edge names its facade."""
    folder = path.rsplit("/", 1)[0] if "/" in path else ""
    for m in re.finditer(r'\bpw_facade\("(\w+)"\)\s*\{', text):
        body = braced(text, m.start())
        backend = b[1] if (b := re.search(r"\bbackend\s*=\s*(\w+)", body)) else ""
        headers = re.findall(r'"([\w/.]+\.h)"', body)
        yield element(f"{folder}:{m[1]}", "LIBRARY", "cpp", folder.split("/")[-1], path, line_of(text, m.start()), default_value=backend, aliases=headers)
    for m in re.finditer(r'\bpw_source_set\("(\w+)"\)\s*\{', text):
        body = braced(text, m.start())
        for dep in re.findall(r'"\$?([\w/]+):(\w+)\.facade"', body):
            yield element(f"{folder}:{m[1]}", "LIBRARY", "cpp", folder.split("/")[-1], path, line_of(text, m.start()), edges=[{"kind": "BACKEND_OF", "target": ":".join(dep)}])
