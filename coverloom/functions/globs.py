"""Path globs as regular expressions, compiled when the plan is built."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTAMINATED = r"(^|/)(vendor|third_party|node_modules|bazel-out|\.git|\.claude|worktrees)(/|$)"
SKIPPED_DIRS = r"(^|/)(\.git|target|node_modules|out)/"


def glob_regex(glob: str) -> str:
    """`*` and `?` stay within a segment, `**` spans any number of them, `[abc]` is a class."""
    glob = glob.removeprefix("./")
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:[^/]*/)*", i + 3
        elif glob.startswith("/**", i) and i + 3 == len(glob):
            out, i = out + "(?:/.*)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def matches_any(path: Column, globs: Sequence[str]) -> Column:
    if not globs:
        return F.lit(False)
    return F.regexp_replace(path, r"^\./", "").rlike("|".join(f"(?:{glob_regex(g)})" for g in globs))


def included(path: Column, include: Sequence[str], exclude: Sequence[str] = ()) -> Column:
    """No include globs mean all paths."""
    inside = matches_any(path, include) if include else F.lit(True)
    return inside & ~matches_any(path, exclude)


def not_contaminated(path: Column) -> Column:
    return ~path.rlike(CONTAMINATED)
