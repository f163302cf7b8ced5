"""Parsers of documentation. Each yields rows of files.CLAIMS."""

from __future__ import annotations

import io
import re
import tarfile
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

from .tests import invocation_refs, line_of

EXAMPLE_LANGUAGES = ("bash", "sh", "shell", "console", "go", "rust", "cpp", "c++", "python", "fidl", "proto", "yaml", "json")
AROUND = 80
_PROTO = re.compile(r"\b((?:[a-z][a-z0-9_]*\.)+[A-Z]\w*[/.][A-Z]\w*)")
_FENCE = re.compile(r"(?ms)^[ \t]*(```+|~~~+)[ \t]*([\w+-]*)[^\n]*\n(.*?)^[ \t]*\1[ \t]*$")


def claim(path: str, line: int, kind: str, adapter: str, refs: list[str], text: str = "", section: list[str] | None = None) -> dict:
    return {"path": path, "line": line, "kind": kind, "adapter": adapter, "refs": list(dict.fromkeys(refs)), "text": text[:300], "words": len(text.split()), "section": section or []}


def _blank(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with spans replaced by spaces of the same length."""
    for a, b in spans:
        text = text[:a] + re.sub(r"[^\n]", " ", text[a:b]) + text[b:]
    return text


def headings(text: str) -> list[tuple[int, int, str]]:
    """(offset, level, title) of headings outside fences."""
    bare = _blank(text, [m.span() for m in _FENCE.finditer(text)])
    return [(m.start(), len(m[1]), m[2].strip(" #")) for m in re.finditer(r"(?m)^(#{1,6})[ \t]+(.+)$", bare)]


def stack_at(found: list[tuple[int, int, str]], at: int) -> list[str]:
    """H1 to H3 above an offset; deeper headings take the third place, and a shallower one clears those below."""
    slots: list[str] = ["", "", ""]
    for offset, level, title in found:
        if offset > at:
            break
        k = min(level, 3) - 1
        slots[k:] = [title] + [""] * (2 - k)
    return [s for s in slots if s]


def qualified(name: str) -> bool:
    return bool(re.search(r"[. ]|::", name))


def markdown(path: str, text: str, binary: str = "") -> Iterator[dict]:
    """Qualified names in backticks and long flags are mentions; fences are examples, or references where they name methods."""
    found, fences = headings(text), list(_FENCE.finditer(text))
    bare = _blank(text, [m.span() for m in fences])
    for m in re.finditer(r"`([^`\n]+)`", bare):
        if qualified(m[1]):
            around = bare[max(0, m.start() - AROUND) : m.end() + AROUND]
            yield claim(path, line_of(text, m.start()), "PROSE_MENTION", "markdown", [m[1].strip(), *invocation_refs(m[1].split(), binary)], around, stack_at(found, m.start()))
    for m in re.finditer(r"(?<![\w-])--[a-z][a-z0-9-]*", text):
        yield claim(path, line_of(text, m.start()), "PROSE_MENTION", "markdown", [m[0]], text[max(0, m.start() - AROUND) : m.end() + AROUND], stack_at(found, m.start()))
    for m in fences:
        refs = _PROTO.findall(m[3]) + [r for line in m[3].split("\n") for r in invocation_refs(line.strip().removeprefix("$ ").split(), binary)]
        if m[2].lower() in EXAMPLE_LANGUAGES and refs:
            yield claim(path, line_of(text, m.start()), "EXAMPLE", "markdown", refs, m[3], stack_at(found, m.start()))
        elif refs:
            yield claim(path, line_of(text, m.start()), "REFERENCE", "markdown", refs, m[3], stack_at(found, m.start()))


def rst(path: str, text: str, binary: str = "") -> Iterator[dict]:
    """Roles, double backticks, directive arguments and code blocks."""
    found: list[tuple[int, int, str]] = []
    order: list[str] = []
    for m in re.finditer(r"(?m)^(?!\s)([^\n]+)\n([=\-~^\"'#*+])\2{2,}\s*$", text):
        if m[2] not in order:
            order.append(m[2])
        found.append((m.start(), order.index(m[2]) + 1, m[1].strip()))
    blocks = list(re.finditer(r"(?m)^\.\. (?:code-block|code|sourcecode)::[ \t]*(\w*)[^\n]*\n((?:[ \t]+[^\n]*\n|\s*\n)+)", text))
    bare = _blank(text, [m.span() for m in blocks])
    for m in re.finditer(r":[\w:]+:`(?:[^`<]*<)?([^`>]+)>?`|``([^`\n]+)``", bare):
        name = (m[1] or m[2]).lstrip("~!").strip()
        if m[1] or qualified(name):
            yield claim(path, line_of(text, m.start()), "PROSE_MENTION", "rst", [name], bare[max(0, m.start() - AROUND) : m.end() + AROUND], stack_at(found, m.start()))
    for m in re.finditer(r"(?m)^\.\. [\w:-]+::[ \t]+(\S[^\n]*)", bare):
        if refs := _PROTO.findall(m[1]):
            yield claim(path, line_of(text, m.start()), "REFERENCE", "rst", refs, m[1], stack_at(found, m.start()))
    for m in blocks:
        refs = _PROTO.findall(m[2]) + [r for line in m[2].split("\n") for r in invocation_refs(line.strip().removeprefix("$ ").split(), binary)]
        if refs:
            yield claim(path, line_of(text, m.start()), "EXAMPLE" if m[1].lower() in EXAMPLE_LANGUAGES else "REFERENCE", "rst", refs, m[2], stack_at(found, m.start()))


def doxygen(path: str, text: str) -> Iterator[dict]:
    """One reference for each described compound and member, once an id."""
    seen: set[str] = set()
    for compound in ET.fromstring(text).iter("compounddef"):
        if compound.get("kind") == "dir":
            continue
        outer = compound.findtext("compoundname") or ""
        for node, name in [(compound, outer), *((m, m.findtext("qualifiedname") or f"{outer}::{m.findtext('name')}") for m in compound.iter("memberdef"))]:
            said = " ".join(" ".join(t.split()) for tag in ("briefdescription", "detaileddescription") if (d := node.find(tag)) is not None for t in d.itertext() if t.strip())
            if said and node.get("id") not in seen:
                seen.add(node.get("id") or "")
                at = node.find("location")
                yield claim(at.get("file", path) if at is not None else path, int(at.get("line", 0)) if at is not None else 0, "REFERENCE", "doxygen", [name], said)


def _sections(text: str) -> Iterator[tuple[int, str, str]]:
    """(line, anchor, prose) of headings with an explicit anchor; fences, tables and rules are no prose."""
    marks = list(re.finditer(r"(?m)^#{1,6}[^\n]*\{#([^}]+)\}[ \t]*$", text))
    for m, end in zip(marks, [*(x.start() for x in marks[1:]), len(text)], strict=True):
        body = _FENCE.sub("", text[m.end() : end])
        prose = [x for x in body.split("\n") if not re.match(r"\s*(\||---|===|<t)", x)]
        yield line_of(text, m.start()), m[1], " ".join(" ".join(prose).split())


def fidldoc(path: str, content: bytes) -> Iterator[dict]:
    """A zip of pages; the page's folder is the library."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name in sorted(n for n in z.namelist() if n.endswith(".md")):
            library = name.rsplit("/", 2)[-2] if "/" in name else name.removesuffix(".md")
            for line, anchor, prose in _sections(z.read(name).decode("utf-8", "replace")):
                yield claim(name, line, "REFERENCE", "fidldoc", [f"{library}/{anchor}"], prose)


def clidoc(path: str, content: bytes) -> Iterator[dict]:
    """A tar.gz of pages; anchors are commands, and each --flag line of a section is a reference, once."""
    with tarfile.open(fileobj=io.BytesIO(content), mode="r:gz") as t:
        for member in sorted((m for m in t.getmembers() if m.isfile() and m.name.endswith(".md")), key=lambda m: m.name):
            text = t.extractfile(member).read().decode("utf-8", "replace")  # type: ignore[union-attr]
            marks = list(re.finditer(r"(?m)^#{1,6}[^\n]*\{#([^}]+)\}[ \t]*$", text))
            for line, anchor, prose in _sections(text):
                yield claim(member.name, line, "REFERENCE", "clidoc", [anchor.replace("_", " ")], prose)
            for m, end in zip(marks, [*(x.start() for x in marks[1:]), len(text)], strict=True):
                for f in dict.fromkeys(re.findall(r"(?m)^\s*[-*]?\s*`?(--[a-z][\w-]*)", text[m.end() : end])):
                    yield claim(member.name, line_of(text, m.end() + text[m.end() : end].find(f)), "REFERENCE", "clidoc", [f"{m[1].replace('_', ' ')} {f}"])


def markdowncli(path: str, text: str, binary: str = "") -> Iterator[dict]:
    """A page for each command: the page, its rows of flags, and its fences."""
    front = re.match(r"(?s)---\n(.*?)\n---\n", text)
    title = re.search(r"(?m)^title:\s*[\"']?([^\"'\n]+)", front[1]) if front else None
    h1 = next((t for _, level, t in headings(text) if level == 1), "")
    stem = path.rsplit("/", 1)[-1].removesuffix(".md").replace("_", " ")
    command = stem if binary and stem.split(" ")[0] == binary else title[1].strip() if title else h1
    yield claim(path, 1, "REFERENCE", "markdowncli", [command], _FENCE.sub("", text))
    flags = []
    for m in re.finditer(r"(?m)^\|[^\n]*?`?(--[a-z][\w-]*)`?[^\n]*\|\s*$|<td>(?:<code>)?(--[a-z][\w-]*)", text):
        flags.append(m[1] or m[2])
        yield claim(path, line_of(text, m.start()), "REFERENCE", "markdowncli", [f"{command} {m[1] or m[2]}"], re.sub(r"[|`]|<[^>]+>", " ", m[0]))
    for m in _FENCE.finditer(text):
        line = line_of(text, m.start())
        yield claim(path, line, "EXAMPLE", "markdowncli", [command], m[3])
        for f in dict.fromkeys(re.findall(r"(--[a-z][\w-]*)", m[3])):
            yield claim(path, line, "EXAMPLE", "markdowncli", [f"{command} {f}"], m[3])


def workflows(path: str, text: str, binary: str = "", min_elements: int = 2) -> Iterator[dict]:
    """One claim a file whose fences name enough distinct commands; the references keep order and repeats."""
    refs = [r for m in _FENCE.finditer(text) for line in m[3].split("\n") for r in invocation_refs(line.strip().removeprefix("$ ").split(), binary)]
    if len(set(refs)) >= max(2, min_elements):
        yield claim(path, 1, "WORKFLOW", "workflows", [], " → ".join(refs)) | {"refs": refs}


def yaml_workflows(path: str, text: str, prefix: str = "", min_elements: int = 2) -> Iterator[dict]:
    """One claim for each YAML block of a page that names enough methods."""
    for m in re.finditer(r"(?m)^\.\. code-block::[ \t]*ya?ml[^\n]*\n((?:[ \t]+[^\n]*\n|\s*\n)+)", text + "\n"):
        refs = list(dict.fromkeys(re.sub(r"\.([A-Z]\w*)\.([A-Z]\w*)$", r".\1/\2", r) for r in _PROTO.findall(m[1]) if r.startswith(prefix)))
        refs = [re.sub(r"\.([A-Z]\w*)/", r"/\1.", r) for r in refs]
        if len(refs) >= max(2, min_elements):
            line = line_of(text, m.start())
            yield claim(f"{path}#L{line}", line, "WORKFLOW", "workflows", refs, m[1])


def flag_tables(html: str) -> str:
    """HTML flag tables as pipe tables."""
    rows = []
    for tr in re.findall(r"(?is)<tr[^>]*>(.*?)</tr>", html):
        cells = [" ".join(re.sub(r"<[^>]+>", " ", c).split()) for c in re.findall(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>", tr)]
        rows.append("| " + " | ".join(cells) + " |")
    return "\n".join([*rows[:1], "|" + " --- |" * rows[0].count(" | ") + " --- |", *rows[1:]]) if rows else ""
