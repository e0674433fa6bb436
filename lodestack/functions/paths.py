"""Path columns: rules, parts, ancestors, module names, documentation categories."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestack.common import suffix


def cleaned(path: Column) -> Column:
    """Forward slashes, no leading ``./``, no slashes at either end."""
    return F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(?:\./)+", ""), r"^/+|/+$", "")


def glob_expression(glob: str) -> str:
    """An anchored expression for a glob whose ``*`` also passes slashes."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and end > 0:
            inner = glob[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + inner[1:] if inner.startswith("!") else inner) + "]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def matches(path: Column, paths: Sequence[str] = (), globs: Sequence[str] = ()) -> Column:
    """Whether one of the rules holds: a path rule for the path itself and everything below it, a glob for the whole path."""
    rules = [(path == r) | path.startswith(r + "/") for r in paths] + [path.rlike(glob_expression(g)) for g in globs]
    out = F.lit(False)
    for rule in rules:
        out = out | rule
    return out


def selected(path: Column, include_paths: Sequence[str] = (), include_globs: Sequence[str] = (), exclude_paths: Sequence[str] = (), exclude_globs: Sequence[str] = ()) -> Column:
    """Included, if there are include rules, and not excluded."""
    clean = cleaned(path)
    included = matches(clean, include_paths, include_globs) if include_paths or include_globs else F.lit(True)
    return included & ~matches(clean, exclude_paths, exclude_globs)


def name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def parent(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"^(.*)/[^/]*$", 0), r"/[^/]*$", "")


def stem(path: Column) -> Column:
    return F.regexp_replace(name(path), r"(?<=[^.])\.[^.]*$", "")


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def ancestors(path: Column) -> Column:
    """The folders above ``path``, from the top down."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def module_name(path: Column) -> Column:
    """The Python module of a ``.py`` file; null if a part is no identifier. A leading ``src`` and a last ``__init__`` go."""
    parts = F.split(F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), "^src/", ""), "/")
    own = F.when(F.element_at(parts, -1) == "__init__", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    good = (F.size(own) > 0) & F.forall(own, lambda p: p.rlike("^[A-Za-z_][A-Za-z0-9_]*$"))
    return F.when(path.endswith(".py") & good, F.array_join(own, "."))


#: Documentation categories in their order.
CATEGORIES = ("Primary documentation", "Architecture", "Specification", "Tasks and roadmap", "Changelog and contribution", "License", "Other documentation")


def _words(path: Column) -> Column:
    return F.split(F.regexp_replace(F.lower(stem(path)), "[-.]", "_"), "_")


def is_documentation(path: Column) -> Column:
    """A text format (or no suffix) and a telling name or a ``docs`` folder above."""
    kind = F.coalesce(suffix(path), F.lit(""))
    texts = kind.isin("", "md", "markdown", "rst", "txt")
    words = _words(path)
    known = ("readme", "architecture", "spec", "specification", "tasks", "task", "roadmap", "milestone", "changelog", "changes", "contributing", "contribution", "contributors", "license", "licence", "copying")
    named = F.arrays_overlap(words, F.array(*[F.lit(w) for w in known])) | F.lower(name(path)).startswith("readme")
    below = F.array_contains(F.transform(ancestors(path), lambda a: F.lower(F.regexp_extract(a, r"([^/]*)$", 1))), F.lit("docs"))
    return texts & (named | below | F.lower(path).startswith("planning/"))


def documentation_category(path: Column) -> Column:
    words, base = _words(path), F.lower(stem(path))

    def has(*wanted: str) -> Column:
        return F.arrays_overlap(words, F.array(*[F.lit(w) for w in wanted]))

    return (
        F.when(base.startswith("readme"), CATEGORIES[0])
        .when(has("architecture"), CATEGORIES[1])
        .when(has("spec", "specification"), CATEGORIES[2])
        .when(has("tasks", "task", "roadmap", "milestone") | F.lower(path).startswith("planning/"), CATEGORIES[3])
        .when(base.isin("changelog", "changes", "contributing", "contribution", "contributors"), CATEGORIES[4])
        .when(has("license", "licence", "copying"), CATEGORIES[5])
        .otherwise(CATEGORIES[6])
    )
