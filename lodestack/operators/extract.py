"""Table functions: what one source file defines, imports, calls and declares. A file that can't be read gives an error row."""

from __future__ import annotations

import ast
import re
import tomllib
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.common import cut
from lodestack.operators import graph


def _table(files: DataFrame, key: str, function: Callable[[str], list[tuple]], fields: str) -> DataFrame:
    names = [key, *(f.strip().split()[0] for f in fields.split(","))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *row) for k, content in zip(batch[key], batch["content"], strict=True) for row in function(content)]
            yield pd.DataFrame(rows, columns=names)

    return files.where("content is not null").select(key, "content").mapInPandas(run, f"{key} {dict(files.dtypes)[key]}, {fields}")


# Python


_UNREADABLE = (SyntaxError, ValueError, RecursionError, MemoryError)


def _symbols_in(tree: ast.Module) -> list[tuple]:
    functions = (ast.FunctionDef, ast.AsyncFunctionDef)
    out: list[tuple] = []
    for node in tree.body:
        if isinstance(node, functions):
            out.append(("function", node.name, node.lineno, node.end_lineno, None, None))
        elif isinstance(node, ast.ClassDef):
            out.append(("class", node.name, node.lineno, node.end_lineno, None, None))
            out += [("method", m.name, m.lineno, m.end_lineno, node.name, None) for m in node.body if isinstance(m, functions)]
    return out


def symbols_of(content: str) -> list[tuple]:
    """``(kind, name, line_start, line_end, parent, error)`` of top-level functions and classes and of the classes' own methods."""
    try:
        return _symbols_in(ast.parse(content))
    except _UNREADABLE as error:
        return [("error", None, getattr(error, "lineno", None), None, None, str(error))]


def python_symbols(files: DataFrame, key: str = "entry_id") -> DataFrame:
    return _table(files, key, symbols_of, "kind string, name string, line_start int, line_end int, parent string, error string")


def _nodes(tree: ast.Module) -> Iterator[tuple[ast.AST, tuple[str, ...], tuple[str, ...]]]:
    """``(node, scope, classes around it)`` of all nodes, depth first in the order of the source, without recursion."""
    stack: list[tuple[ast.AST, tuple[str, ...], tuple[str, ...]]] = [(tree, (), ())]
    while stack:
        node, scope, classes = stack.pop()
        yield node, scope, classes
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            scope = (*scope, node.name)
            classes = (*classes, node.name) if isinstance(node, ast.ClassDef) else classes
        stack += [(child, scope, classes) for child in reversed(list(ast.iter_child_nodes(node)))]


def _statements(tree: ast.Module) -> Iterator[ast.stmt]:
    """All statements in the order of the source; expressions, which hold none, aren't entered."""
    stack: list[ast.AST] = list(reversed(tree.body))
    while stack:
        node = stack.pop()
        if isinstance(node, ast.stmt):
            yield node
        for field in ("finalbody", "orelse", "handlers", "cases", "body"):
            if isinstance(inner := getattr(node, field, None), list):
                stack += reversed(inner)


def _imports_in(tree: ast.Module) -> list[tuple]:
    rows: list[tuple] = []
    for node in _statements(tree):
        if isinstance(node, ast.Import):
            rows += [("import", a.name, None, a.asname, 0, node.lineno, len(rows) + i, None) for i, a in enumerate(node.names)]
        elif isinstance(node, ast.ImportFrom):
            rows += [("from", node.module, a.name, a.asname, node.level, node.lineno, len(rows) + i, None) for i, a in enumerate(node.names)]
    return rows


def imports_of(content: str) -> list[tuple]:
    """``(import_type, imported_module, imported_name, alias, level, line_number, visit_ord, error)`` of every import, depth first."""
    try:
        return _imports_in(ast.parse(content))
    except _UNREADABLE as error:
        return [("error", None, None, None, 0, getattr(error, "lineno", None), 0, str(error))]


def python_imports(files: DataFrame, key: str = "entry_id") -> DataFrame:
    return _table(files, key, imports_of, "import_type string, imported_module string, imported_name string, alias string, level int, line_number int, visit_ord int, error string")


def _calls_in(tree: ast.Module) -> list[tuple]:
    """Call sites with the scope they stand in: functions join with dots, a class is the prefix of its methods."""
    rows: list[tuple] = []
    for node, scope, classes in _nodes(tree):
        if isinstance(node, ast.Call):
            caller, owner, f = ".".join(scope) or "<module>", classes[-1] if classes else None, node.func
            if isinstance(f, ast.Name):
                rows.append((caller, owner, "name", None, f.id, node.lineno, len(rows)))
            elif isinstance(f, ast.Attribute):
                rows.append((caller, owner, "attribute", f.value.id if isinstance(f.value, ast.Name) else None, f.attr, node.lineno, len(rows)))
    return rows


def calls_of(content: str) -> list[tuple]:
    """``(caller, owner, form, base, callee, line_number, visit_ord)``; a file that can't be parsed has none (``symbols_of`` gives its error)."""
    try:
        return _calls_in(ast.parse(content))
    except _UNREADABLE:
        return []


def python_calls(files: DataFrame, key: str = "entry_id") -> DataFrame:
    return _table(files, key, calls_of, "caller string, owner string, form string, base string, callee string, line_number int, visit_ord int")


FACT = "fact string, kind string, name string, parent string, alias string, level int, line_start int, line_end int, visit_ord int, scope string, error string"


def facts_of(content: str, calls: bool = True) -> list[tuple]:
    """Symbols, imports and, if asked for, calls from one parse, tagged 'symbol', 'import' and 'call'; one 'error' for a file that can't be read."""
    try:
        tree = ast.parse(content)
    except _UNREADABLE as error:
        return [("error", None, None, None, None, None, getattr(error, "lineno", None), None, 0, None, str(error))]
    out = [("symbol", kind, name, parent, None, None, start, end, i, None, None) for i, (kind, name, start, end, parent, _) in enumerate(_symbols_in(tree))]
    out += [("import", kind, name, module, alias, level, line, None, i, None, None) for kind, module, name, alias, level, line, i, _ in _imports_in(tree)]
    if calls:
        out += [("call", form, callee, base, owner, None, line, None, i, caller, None) for caller, owner, form, base, callee, line, i in _calls_in(tree)]
    return out


class PythonFacts:
    """What all Python files define, import and call: every file is parsed once, and equal rows of a file count once."""

    def __init__(self, files: DataFrame, key: str = "entry_id", calls: bool = True):
        read = facts_of if calls else partial(facts_of, calls=False)
        self.key, self.rows = key, cut(_table(files, key, read, FACT).distinct())

    def _of(self, fact: str, *columns: Column) -> DataFrame:
        return self.rows.where(F.col("fact") == fact).select(self.key, *columns)

    def symbols(self) -> DataFrame:
        return self._of("symbol", "kind", "name", "line_start", "line_end", "parent")

    def imports(self) -> DataFrame:
        return self._of("import", F.col("kind").alias("import_type"), F.col("parent").alias("imported_module"), F.col("name").alias("imported_name"), "alias", "level", F.col("line_start").alias("line_number"), "visit_ord")

    def calls(self) -> DataFrame:
        return self._of("call", F.col("scope").alias("caller"), F.col("alias").alias("owner"), F.col("kind").alias("form"), F.col("parent").alias("base"), F.col("name").alias("callee"), F.col("line_start").alias("line_number"), "visit_ord")

    def errors(self) -> DataFrame:
        return self._of("error", F.col("line_start").alias("line_number"), F.col("error").alias("message"))

    def resolved_imports(self, files: DataFrame, scope: str) -> DataFrame:
        """Imports with ``source_module, source_path, target_module, target_path, resolution`` within ``scope``; ``files`` are (key, scope, path)."""
        from lodestack.functions.paths import module_name

        own = files.where(F.col("path").endswith(".py")).select(self.key, scope, "path", module_name(F.col("path")).alias("module")).where("module is not null").distinct()
        sources = own.select(self.key, scope, F.col("module").alias("source_module"), F.col("path").alias("source_path"))
        references = self.imports().join(sources, self.key).withColumn("reference_id", F.concat_ws("-", F.col(self.key).cast("string"), F.col("visit_ord").cast("string")))
        return graph.resolve_imports(references, own.select(scope, "module", "path"), scope)

    def resolved_calls(self, files: DataFrame, scope: str, found: DataFrame | None = None) -> DataFrame:
        """Calls with ``confidence``, ``callee_qualified_name`` and, of imported functions of the same scope, ``target_path``.

        A name imported from a module of the scope that defines exactly one such top-level function is 'imported_local'. ``found`` are the resolved imports, if they are at hand.
        """
        found = self.resolved_imports(files, scope) if found is None else found
        own = files.select(self.key, scope, "path").distinct()
        defined = self.symbols().where("kind = 'function'").join(own, self.key).groupBy(scope, F.col("path").alias("target_path"), F.col("name").alias("imported_name")).agg(F.count("*").alias("n_defined"))
        told = found.join(defined, [scope, "target_path", "imported_name"], "left").select(self.key, "visit_ord", "resolution", "target_module", F.when((F.col("import_type") == "from") & (F.col("n_defined") == 1), F.col("target_path")).alias("target_path"))
        return resolve_calls(self.calls(), self.symbols(), self.imports(), self.key, told)


def resolve_calls(calls: DataFrame, symbols: DataFrame, imports: DataFrame, key: str = "entry_id", resolved: DataFrame | None = None) -> DataFrame:
    """Call sites with ``confidence``: how sure it is what a call means, from counts of definitions in the file and imported names.

    Names: one definition and no import of the name is 'local', several or one beside an import 'ambiguous'; none is
    'imported_local', 'external' or 'unresolved' by what the import is. ``self``, ``cls`` and the own class: 'local_method' by
    the count of such methods; an attribute of an external import is 'external'; a chained one 'unresolved_method', anything
    else 'unresolved'. ``resolved`` (key, visit_ord, resolution, target_module, target_path of the one definition) tells
    imports of the own repository; without it every import counts as external.
    """
    functions = symbols.where("kind = 'function'").groupBy(key, F.col("name").alias("callee")).agg(F.count("*").alias("n_functions"))
    methods = symbols.where("kind = 'method'").groupBy(key, F.col("parent").alias("owner"), F.col("name").alias("callee")).agg(F.count("*").alias("n_methods"))
    local = F.coalesce("alias", F.when(F.col("import_type") == "from", F.col("imported_name")).otherwise(F.regexp_extract("imported_module", r"^([^.]*)", 1)))
    named = imports.where("import_type <> 'error'").select(key, local.alias("bound"), F.concat_ws(".", "imported_module", "imported_name").alias("qualified"), "imported_name", "visit_ord")
    if resolved is None:
        named = named.withColumns({"resolution": F.lit("external"), "target_module": F.lit(None).cast("string"), "target_path": F.lit(None).cast("string")})
    else:
        named = named.join(resolved, [key, "visit_ord"], "left").withColumn("resolution", F.coalesce("resolution", F.lit("unresolved")))
    qualified = F.when(F.col("target_path").isNotNull(), F.concat_ws(".", "target_module", "imported_name")).when(F.col("resolution") == "external", F.col("qualified"))
    last = named.groupBy(key, "bound").agg(F.max(F.struct("visit_ord", "resolution", "target_path", qualified.alias("qualified"))).alias("b")).select(key, "bound", F.col("b.resolution").alias("bound_as"), F.col("b.target_path").alias("target_path"), F.col("b.qualified").alias("bound_to"))
    bound = F.when(F.col("form") == "name", F.col("callee")).otherwise(F.col("base"))
    joined = calls.withColumn("bound", bound).join(functions, [key, "callee"], "left").join(methods, [key, "owner", "callee"], "left").join(last, [key, "bound"], "left")
    n, m = F.coalesce("n_functions", F.lit(0)), F.coalesce("n_methods", F.lit(0))
    own = F.col("base").isin("self", "cls") | (F.col("base") == F.col("owner"))
    external, of_scope = F.coalesce(F.col("bound_as") == "external", F.lit(False)), F.col("target_path").isNotNull()
    by_name = F.when((n == 1) & ~external & ~of_scope, "local").when(n >= 1, "ambiguous").when(of_scope, "imported_local").when(external, "external").otherwise("unresolved")
    by_base = (
        F.when(F.col("base").isNull(), "unresolved_method")
        .when(own & F.col("owner").isNotNull(), F.when(m == 1, "local_method").when(m > 1, "ambiguous").otherwise("unresolved"))
        .when(external, "external")
        .otherwise("unresolved")
    )
    confidence = F.when(F.col("form") == "name", by_name).otherwise(by_base)
    told = joined.withColumn("confidence", confidence)
    target = F.when(F.col("confidence").isin("external", "imported_local"), F.when(F.col("form") == "name", F.col("bound_to")).otherwise(F.concat_ws(".", "bound_to", "callee")))
    path = F.when(F.col("confidence") == "imported_local", F.col("target_path"))
    return told.withColumn("callee_qualified_name", target).withColumn("target_path", path).drop("bound", "n_functions", "n_methods", "bound_as", "bound_to")


# Bash

_BASH_HEAD = re.compile(r"^[ \t]*(?:function[ \t]+)?([A-Za-z_][\w-]*)[ \t]*(?:\([ \t]*\))?[ \t]*\{(?=\s|$)")
# Words that are no function names and no calls.
_BASH_WORDS = frozenset("if then else elif fi for while until do done case esac in select function time coproc".split())
_BASH_BUILTINS = frozenset("local export declare readonly return exit set unset shift echo printf read cd source eval exec trap test true false break continue".split())
_QUOTED = re.compile(r"'[^']*'|\"(?:[^\"\\]|\\.)*\"|(?<![^\s;|&()])#.*")
_HEREDOC = re.compile(r"(?<!<)<<-?\s*([\"']?)(\w+)\1")


def _bash_lines(content: str) -> list[str]:
    """Lines without quotes and comments; the bodies of here-documents are blank."""
    out, until = [], None
    for line in content.split("\n"):
        if until is not None:
            if line.strip() == until:
                until = None
            out.append("")
            continue
        if m := _HEREDOC.search(line):
            until = m.group(2)
        out.append(_QUOTED.sub(lambda q: " " * len(q.group()), line))
    return out


def bash_functions_of(content: str) -> list[tuple]:
    """``(name, start_line, end_line)``; functions within a body are passed over, one without an end is one line."""
    lines, out, k = _bash_lines(content), [], 0
    while k < len(lines):
        m = _BASH_HEAD.match(lines[k])
        if not m or m.group(1) in _BASH_WORDS:
            k += 1
            continue
        depth, end = 0, None
        for j in range(k, len(lines)):
            depth += lines[j].count("{") - lines[j].count("}")
            if depth <= 0:
                end = j
                break
        out.append((m.group(1), k + 1, (k if end is None else end) + 1))
        k = (k if end is None else end) + 1
    return out


def bash_calls_of(content: str) -> list[tuple]:
    """``(caller, callee, line_number)`` of every first word in a function's body that may be a function."""
    lines, out = _bash_lines(content), []
    for name, start, end in bash_functions_of(content):
        for number in range(start, end + 1):
            body = lines[number - 1]
            if number == start:
                body = body[body.index("{") + 1 :]
            for part in re.split(r"&&|\|\||[;|]", body):
                words = part.strip().strip("(){} \t").split()
                while words and words[0] in ("if", "elif", "while", "until", "then", "do", "else", "!", "time", "command", "builtin"):
                    words = words[1:]
                if words and re.fullmatch(r"[A-Za-z_][\w-]*", words[0]) and words[0] not in _BASH_WORDS | _BASH_BUILTINS:
                    out.append((name, words[0], number))
    return out


def bash_functions(files: DataFrame, key: str = "entry_id") -> DataFrame:
    return _table(files, key, bash_functions_of, "name string, start_line int, end_line int")


def bash_call_edges(files: DataFrame, key: str = "entry_id", scope: Column | None = None) -> DataFrame:
    """Calls whose name is a function of the file (or, with ``scope``, of any file of the scope; the first definition counts)."""
    group = (scope if scope is not None else F.col(key)).alias("scope")
    defined = bash_functions(files, key).join(files.select(key, group).distinct(), key).groupBy("scope", F.col("name").alias("callee")).agg(F.min(F.struct(F.col(key).alias("callee_file"), F.col("start_line").alias("callee_line"))).alias("d"))
    calls = _table(files, key, bash_calls_of, "caller string, callee string, call_line int").join(files.select(key, group).distinct(), key)
    return calls.join(defined, ["scope", "callee"]).select(key, "caller", "callee", "call_line", F.col("d.callee_file").alias("callee_file"), F.col("d.callee_line").alias("callee_line")).distinct()


# SQL definitions

_CREATE = re.compile(r"create\s+(?:temp(?:orary)?\s+)?table\s+(?:if\s+not\s+exists\s+)?", re.IGNORECASE)
_IDENTIFIER = re.compile(r"\"((?:[^\"]|\"\")*)\"|`([^`]*)`|\[([^\]]*)\]|([\w$]+)")
_CONSTRAINT = ("constraint", "primary", "foreign", "unique", "check", "exclude")
_TYPE_ENDS = frozenset("primary not null default unique check references collate generated as constraint".split())


def sql_statements(text: str) -> list[str]:
    """Statements without comments, cut at semicolons outside of quotes and brackets."""
    out, part, depth, i = [], [], 0, 0
    while i < len(text):
        c = text[i]
        if c in "'\"`":
            end = i + 1
            while (end := text.find(c, end)) >= 0 and text[end + 1 : end + 2] == c:
                end += 2
            end = len(text) if end < 0 else end + 1
            part.append(text[i:end])
            i = end
            continue
        if text.startswith("--", i):
            end = text.find("\n", i)
            i = len(text) if end < 0 else end
            continue
        if text.startswith("/*", i):
            end = text.find("*/", i + 2)
            i = len(text) if end < 0 else end + 2
            part.append(" ")
            continue
        depth += (c in "([") - (c in ")]")
        if c == ";" and depth <= 0:
            out.append("".join(part).strip())
            part = []
        else:
            part.append(c)
        i += 1
    out.append("".join(part).strip())
    return [s for s in out if s]


def _top_level(body: str) -> list[str]:
    out, depth, part, quote = [], 0, [], ""
    for c in body:
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        else:
            depth += (c == "(") - (c == ")")
            if c == "," and not depth:
                out.append("".join(part).strip())
                part = []
                continue
        part.append(c)
    return [x for x in [*out, "".join(part).strip()] if x]


def _created(statement: str) -> re.Match | None:
    """The last part of the name of the table that a statement creates."""
    m = _CREATE.match(statement)
    name = m and _IDENTIFIER.match(statement, m.end())
    while name and statement[name.end() : name.end() + 1] == "." and (further := _IDENTIFIER.match(statement, name.end() + 1)):
        name = further
    return name


def tables_of(text: str) -> list[tuple]:
    """``(table_name, position, column_name, data_type, nullable, default_value, is_primary_key)``; a table without a readable body has one row of nulls."""
    out: list[tuple] = []
    for statement in sql_statements(text):
        if not (name := _created(statement)):
            continue
        table = next(g for g in name.groups() if g is not None)
        start, end = statement.find("(", name.end()), statement.rfind(")")
        rows = []
        for item in _top_level(statement[start + 1 : end]) if 0 <= start < end else []:
            column = _IDENTIFIER.match(item)
            if not column or (column.group(4) or "").lower() in _CONSTRAINT:
                continue
            rest = item[column.end() :].strip()
            words, kind = rest.split(), []
            for w in words:
                if w.lower() in _TYPE_ENDS:
                    break
                kind.append(w)
            low = rest.lower()
            nullable = False if re.search(r"\bnot\s+null\b", low) else True if re.search(r"\bnull\b", low) else None
            default = re.search(r"\bdefault\s+('(?:[^']|'')*'|\([^)]*\)|\S+)", rest, re.IGNORECASE)
            rows.append((table, len(rows), next(g for g in column.groups() if g is not None), " ".join(kind) or None, nullable, default and default.group(1), bool(re.search(r"\bprimary\s+key\b", low))))
        out += rows or [(table, None, None, None, None, None, None)]
    return out


def sql_tables(files: DataFrame, key: str = "entry_id") -> DataFrame:
    return _table(files, key, tables_of, "table_name string, position int, column_name string, data_type string, nullable boolean, default_value string, is_primary_key boolean")


def foreign_keys_of(text: str) -> list[tuple]:
    """``(table_name, from_column, to_table, to_column, on_delete, on_update)`` of table-level foreign keys, by their first column."""
    ident = r"[\"`\[]?([\w$]+)[\"`\]]?"
    rule = re.compile(rf"foreign\s+key\s*\(\s*{ident}[^)]*\)\s*references\s+{ident}\s*(?:\(\s*{ident}[^)]*\))?([^,]*)", re.IGNORECASE)
    out = []
    for statement in sql_statements(text):
        name = _created(statement)
        for fk in rule.finditer(statement) if name else ():
            actions = {a.lower(): b.upper() for a, b in re.findall(r"on\s+(delete|update)\s+(cascade|restrict|set\s+null|set\s+default|no\s+action)", fk.group(4), re.IGNORECASE)}
            out.append((next(g for g in name.groups() if g is not None), fk.group(1), fk.group(2), fk.group(3), actions.get("delete"), actions.get("update")))
    return out


def sql_foreign_keys(files: DataFrame, key: str = "entry_id") -> DataFrame:
    return _table(files, key, foreign_keys_of, "table_name string, from_column string, to_table string, to_column string, on_delete string, on_update string")


# dependencies

DEPENDENCY_TYPES = ("runtime", "development", "optional", "unknown")
_DEVELOPMENT = frozenset("dev test tests docs doc lint quality".split())
_REQUIREMENT = re.compile(r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*(\[[^\]]*\])?\s*([^;#]*)")


def normal_name(name: str) -> str:
    return re.sub(r"[-_.]+", "-", name.split("[")[0].strip()).lower()


def normalized_name(name: Column) -> Column:
    """``normal_name`` as an expression."""
    return F.lower(F.regexp_replace(F.trim(F.regexp_extract(name, r"^([^\[]*)", 1)), "[-_.]+", "-"))


def toml_dependencies_of(content: str) -> list[tuple]:
    """``(name, normalized_name, version_constraint, dependency_type, source_section, group_name, error)`` of a project file."""
    try:
        data = tomllib.loads(content)
    except (tomllib.TOMLDecodeError, RecursionError) as error:
        return [(None, None, None, "error", None, None, str(error))]
    out: list[tuple] = []

    def listed(items, kind: str, section: str, group: str | None) -> None:
        for item in items if isinstance(items, list) else ():
            if isinstance(item, str) and (m := _REQUIREMENT.match(item)):
                out.append((m[1], normal_name(m[1]), m[3].strip() or None, kind, section, group, None))

    def mapped(items, kind: str, section: str, group: str | None) -> None:
        for name, value in items.items() if isinstance(items, dict) else ():
            if name.lower() != "python":
                constraint = value if isinstance(value, str) else value.get("version") if isinstance(value, dict) else None
                out.append((name, normal_name(name), constraint, kind, section, group, None))

    project = data.get("project") if isinstance(data.get("project"), dict) else {}
    listed(project.get("dependencies"), "runtime", "project.dependencies", None)
    optional = project.get("optional-dependencies")
    for group, items in optional.items() if isinstance(optional, dict) else ():
        listed(items, "optional", "project.optional-dependencies", group)
    tool = data.get("tool") if isinstance(data.get("tool"), dict) else {}
    poetry = tool.get("poetry") if isinstance(tool.get("poetry"), dict) else {}
    mapped(poetry.get("dependencies"), "runtime", "tool.poetry.dependencies", None)
    mapped(poetry.get("dev-dependencies"), "development", "tool.poetry.dev-dependencies", "dev")
    groups = poetry.get("group")
    for group, value in groups.items() if isinstance(groups, dict) else ():
        mapped(value.get("dependencies") if isinstance(value, dict) else None, "development" if group.lower() in _DEVELOPMENT else "optional", f"tool.poetry.group.{group}", group)
    return out


def toml_dependencies(files: DataFrame, key: str = "entry_id") -> DataFrame:
    return _table(files, key, toml_dependencies_of, "name string, normalized_name string, version_constraint string, dependency_type string, source_section string, group_name string, error string")


def requirement_lines(files: DataFrame, key: str = "entry_id", path: str = "path") -> DataFrame:
    """Dependencies of requirement files from SQL expressions alone; options and links are 'warning' rows."""
    line = F.trim(F.regexp_replace("raw", r"(?:^|\s)#.*$", ""))
    rows = files.where("content is not null").select(key, path, F.posexplode(F.split("content", r"\r?\n")).alias("pos", "raw")).withColumn("line", line).where("line <> ''")
    name = F.regexp_extract("line", r"^([A-Za-z0-9][A-Za-z0-9._-]*)", 1)
    other = F.col("line").startswith("-") | F.col("line").rlike(r"^(?:git|hg|svn|bzr)\+|://") | (name == "")
    file = F.lower(F.regexp_extract(path, r"([^/]*)$", 1))
    kind = F.when(other, "warning").when(file == "requirements.txt", "runtime").when(F.lower(F.col(path)).rlike(r"(?:^|[-_./])(?:dev|test|tests|lint|docs|doc)(?:[-_./]|$)"), "development").otherwise("unknown")
    constraint = F.trim(F.regexp_extract("line", r"^[A-Za-z0-9][A-Za-z0-9._-]*\s*(?:\[[^\]]*\])?\s*([^;]*)", 1))
    normal = normalized_name(name)
    return rows.select(key, (F.col("pos") + 1).alias("line_number"), F.when(~other, name).alias("name"), F.when(~other, normal).alias("normalized_name"), F.when(~other, F.nullif(constraint, F.lit(""))).alias("version_constraint"), kind.alias("dependency_type"))


def dependency_counts(dependencies: DataFrame) -> DataFrame:
    """Dependencies by type, with zeros."""
    spark = dependencies.sparkSession
    order = spark.createDataFrame([(i, t) for i, t in enumerate(DEPENDENCY_TYPES)], "position int, dependency_type string")
    n = dependencies.groupBy("dependency_type").agg(F.count("*").alias("n"))
    return order.join(n, "dependency_type", "left").select("position", "dependency_type", F.coalesce("n", F.lit(0)).alias("n_dependencies"))


def console_scripts(files: DataFrame, key: str = "entry_id") -> DataFrame:
    """``name, target`` of the lines in ``[project.scripts]`` and ``[tool.poetry.scripts]``: the section is carried forward over the lines."""
    from pyspark.sql import Window

    rows = files.where("content is not null").select(key, F.posexplode(F.split("content", r"\r?\n")).alias("pos", "line"))
    section = F.nullif(F.regexp_extract("line", r"^\s*\[([^\]]+)\]\s*$", 1), F.lit(""))
    carried = rows.withColumn("section", F.last(section, ignorenulls=True).over(Window.partitionBy(key).orderBy("pos")))
    pair = carried.where(F.col("section").isin("project.scripts", "tool.poetry.scripts")).select(key, F.regexp_extract("line", r"^\s*\"?([\w.-]+)\"?\s*=", 1).alias("name"), F.regexp_extract("line", r"=\s*[\"']([^\"']+)[\"']", 1).alias("target"))
    return pair.where("name <> '' and target <> ''")


def script_paths(scripts: DataFrame, files: DataFrame, scope: str) -> DataFrame:
    """``scope, path`` of the files that console scripts (``scope, target``) start: candidates are exploded and joined by equality."""
    module = F.replace(F.trim(F.regexp_extract("target", r"^([^:]*)", 1)), F.lit("."), F.lit("/"))
    wanted = scripts.select(scope, module.alias("m")).where("m <> ''").select(scope, F.explode(F.array(F.concat("m", F.lit(".py")), F.concat(F.lit("src/"), "m", F.lit(".py")))).alias("path"))
    return wanted.distinct().join(files.select(scope, "path").distinct(), [scope, "path"])


def purpose(files: DataFrame, key: str) -> DataFrame:
    """The first line of a text that is neither blank nor a heading, else its first heading."""
    lines = F.filter(F.transform(F.split("content", r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    plain = F.get(F.filter(lines, lambda x: ~x.startswith("#")), F.lit(0))
    heading = F.trim(F.regexp_replace(F.get(lines, F.lit(0)), "^#+", ""))
    return files.where("content is not null").select(key, F.coalesce(plain, heading).alias("purpose"))


def definition_lines(content: Column) -> Column:
    """Lines that begin like a Python definition."""
    return F.size(F.filter(F.split(content, "\n"), lambda x: x.rlike(r"^\s*(?:def|class|async def)\s")))
