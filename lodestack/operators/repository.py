"""Calls and imports of whole repositories: one task reads all Python files of one and resolves what they use, so that facts aren't shuffled.

The rows are those of ``extract.PythonFacts``, which joins facts instead and so suits files that are read where they lie. Here
the files are grouped by repository; where they already are (as after a window over it), nothing is shuffled at all.
"""

from __future__ import annotations

import ast
import keyword
import pickle
import re
import tempfile
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import islice
from operator import itemgetter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.operators import extract

# reading


class Plan(NamedTuple):
    """What a file defines, imports and calls. Names are places in a list of values, of which the first is None."""

    defined: tuple[int, ...]  #: names of top-level functions, as often as they are defined
    imports: tuple[tuple, ...]  #: (whether by ``import``, module, name, level)
    calls: tuple[tuple, ...]  #: (caller, callee, line, visit_ord, whether by name, confidence by ``_STATES``, import or -1)


#: What the import is that a name is bound to: none or one of nothing known, external, the one function of a file of the repository.
_STATES = _UNKNOWN, _EXTERNAL, _OWN = 0, 1, 2


def _confidence(form: str, base: str | None, owner: str | None, n: int, m: int, state: int) -> str:
    """As in ``extract.resolve_calls``."""
    if form == "name":
        if n:
            return "local" if n == 1 and state == _UNKNOWN else "ambiguous"
        return ("unresolved", "external", "imported_local")[state]
    if base is None:
        return "unresolved_method"
    if owner is not None and (base in ("self", "cls") or base == owner):
        return "unresolved" if not m else "local_method" if m == 1 else "ambiguous"
    return "external" if state == _EXTERNAL else "unresolved"


def plan_of(content: str) -> tuple[Plan, list] | None:
    """The plan and the values of one file; None if it can't be read."""
    try:
        tree = ast.parse(content)
        symbols, imports, calls = extract._symbols_in(tree), extract._imports_in(tree), extract._calls_in(tree)
    except extract._UNREADABLE:
        return None
    at: dict = {None: 0}
    place = lambda value: at.setdefault(value, len(at))
    functions = Counter(name for kind, name, *_ in symbols if kind == "function")
    methods = Counter((parent, name) for kind, name, _, _, parent, _ in symbols if kind == "method")
    bound = {alias or (name if kind == "from" else module.split(".")[0]): i for i, (kind, module, name, alias, *_) in enumerate(imports)}  # the last one counts
    rows = []
    for caller, owner, form, base, callee, line, order in calls:
        told = tuple(_confidence(form, base, owner, functions[callee], methods[owner, callee] if owner is not None else 0, s) for s in _STATES)
        rows.append((place(caller), place(callee), line, order, form == "name", told, bound.get(callee if form == "name" else base, -1)))
    brought = tuple((kind == "import", place(module), place(name), level) for kind, module, name, _, level, *_ in imports)
    defined = tuple(place(name) for kind, name, *_ in symbols if kind == "function")
    return Plan(defined, brought, tuple(rows)), list(at)


_WORD = re.compile(r"(?<![0-9A-Za-z_])([A-Za-z_][0-9A-Za-z_]*)")
_PLACEHOLDER = re.compile(r"_(\d+)_")
#: Words that the grammar or ``_confidence`` know; all others may be replaced, the same ones by the same, without another tree.
_KEPT = {w: i for i, w in enumerate(dict.fromkeys([*keyword.kwlist, *keyword.softkwlist, "self", "cls", "print", "exec", "__debug__", "__future__", "barry_as_FLUFL"]))}
#: Texts with strings, comments, continued lines, other letters or a number that a name may be part of are parsed as they are.
_NOT_PLAIN = re.compile(r"['\"#\\]|[^\x00-\x7f]|[0-9]\.$")
#: Texts up to so many characters are compared by shape; so many shapes are kept, and so many of them tried first.
_SHORT, _MOST_SHAPES, _RECENT = 4_000, 10_000, 4


class Reader:
    """Parses files. Of short plain ones that differ in their names only, one is parsed and the names of the others are put into its plan."""

    def __init__(self):
        self.shapes: dict = {}
        self.recent: list[tuple] = []

    def read(self, content: str) -> tuple[Plan, list] | None:
        if len(content) > _SHORT:
            return plan_of(content)
        for k, (matches, template) in enumerate(self.recent):
            if (m := matches(content)) and len(set(names := m.groups())) == len(names) and _KEPT.keys().isdisjoint(names):
                if k:
                    self.recent.insert(0, self.recent.pop(k))
                return self._filled(template, names)
        parts = _WORD.split(content)
        at = dict(_KEPT)
        words = tuple([at.setdefault(w, len(at)) for w in parts[1::2]])
        shape = (tuple(parts[::2]), words)
        known = self.shapes.get(shape, 0)
        if known == 0:  # a shape that doesn't come again gets no template
            if len(self.shapes) >= _MOST_SHAPES:
                self.shapes.clear()
            self.shapes[shape] = 1
        if known == 1:
            known = self.shapes[shape] = self._template(shape)
        if not known or known == 1:
            return plan_of(content)
        self.recent = [(self._expression(shape).fullmatch, known), *self.recent[: _RECENT - 1]]
        return self._filled(known, tuple(islice(at, len(_KEPT), None)))

    @staticmethod
    def _filled(template: tuple, names: tuple[str, ...]) -> tuple[Plan, tuple]:
        plan, constants, single, joined = template
        names += constants
        values = single(names)
        return plan, values + tuple([".".join([names[i] for i in c]) for c in joined]) if joined else values

    @staticmethod
    def _expression(shape: tuple) -> re.Pattern:
        """All texts of a shape, if the groups are different names and none of them is kept."""
        kept, group, out = list(_KEPT), {}, []
        for apart, word in zip(shape[0], [*shape[1], None], strict=True):
            out.append(re.escape(apart))
            if word is None:
                break
            if word < len(kept):
                out.append(kept[word])
            elif word in group:
                out.append(f"(?:\\{group[word]})(?![0-9A-Za-z_])")
            else:
                group[word] = len(group) + 1
                out.append("([A-Za-z_][0-9A-Za-z_]*+)")
        return re.compile("".join(out))

    @staticmethod
    def _template(shape: tuple) -> tuple | None:
        """The plan of a shape, what else than names is among its values, and how they are put together; None if it can't be read."""
        if any(map(_NOT_PLAIN.search, shape[0])):
            return None
        kept, n = list(_KEPT), max(shape[1], default=0) + 1 - len(_KEPT)
        words = [kept[i] if i < len(kept) else f"_{i}_" for i in shape[1]]
        found = plan_of("".join(x for pair in zip(shape[0], [*words, ""], strict=True) for x in pair))
        if found is None:
            return None
        plan, values = found
        constants: dict = {}

        def name(text: str | None) -> int:
            m = _PLACEHOLDER.fullmatch(text or "")
            return int(m.group(1)) - len(kept) if m else max(n, 0) + constants.setdefault(text, len(constants))

        singles, joined = {}, {}
        for i, value in enumerate(values):
            if value is not None and "." in value:
                joined[i] = tuple(name(x) for x in value.split("."))
            else:
                singles[i] = name(value)
        place = {i: k for k, i in enumerate([*singles, *joined])}
        get = itemgetter(*singles.values()) if len(singles) > 1 else (lambda names, i=singles[0]: (names[i],))
        moved = Plan(tuple(place[i] for i in plan.defined), tuple((w, place[m], place[x], level) for w, m, x, level in plan.imports), tuple((place[a], place[b], *rest) for a, b, *rest in plan.calls))
        return moved, tuple(constants), get, list(joined.values())


# resolving

_PART = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(?:\r\n|[\n\r\x85\u2028\u2029])?")


def module_of(path: str | None) -> str | None:
    """``paths.module_name`` of one path."""
    if path is None or not path.endswith(".py"):
        return None
    if (stem := path[:-3]).isascii() and stem.isidentifier() and stem != "__init__":
        return stem
    parts = path[:-3].removeprefix("src/").split("/")
    if parts[-1] == "__init__":
        parts.pop()
    return ".".join(parts) if parts and all(map(_PART.fullmatch, parts)) else None


def candidates(module: str, imported: str | None, name: str, level: int, is_package: bool) -> list[str]:
    """``graph.import_candidates`` of a relative import."""
    parts = module.split(".")
    package = parts if is_package else parts[:-1]
    hops = len(package) - (level - 1)
    if hops < 0:
        return []
    prefix = ".".join([*package[:hops], *([imported] if imported else [])])
    named = [] if name == "*" else [f"{prefix}.{name}" if prefix else name]
    return [*named, prefix] if imported else named


_UNBOUND = (_UNKNOWN, None, None, None)
#: So many values are held by a task; more of one repository wait in a temporary file.
MOST_HELD = 500_000


class _Repository:
    """The files of one repository: first all are read, then what each imports is looked up among their modules and functions."""

    def __init__(self, reader: Reader, batches: Iterator[pa.RecordBatch], known: bool):
        self.known, self.modules, self.functions = known, {}, {}
        self.held, self.n, self.kept = [], 0, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("path", "content", *batch.schema.names[3:])]
            for path, content, *rest in zip(*columns, strict=True):
                plan, values = (None if content is None else reader.read(content)) or (None, ())
                module = module_of(path)
                if module is not None:
                    self.modules[module] = min(path, self.modules.get(module, path))
                    if plan is not None and plan.defined:
                        self.functions[path] = self.functions.get(path, ()) + tuple([values[i] for i in plan.defined])
                self.held.append((path, module, plan, values, rest))
                self.n += len(values) + 4
                if self.n > MOST_HELD:
                    self.kept = self.kept or tempfile.TemporaryFile()
                    pickle.dump(self.held, self.kept, pickle.HIGHEST_PROTOCOL)
                    self.held, self.n = [], 0

    def files(self) -> Iterator[tuple]:
        """(path, module, plan, values, other columns)"""
        if self.kept:
            self.kept.seek(0)
            while True:
                try:
                    yield from pickle.load(self.kept)
                except EOFError:
                    break
        yield from self.held

    def defines_once(self, path: str, name: str) -> bool:
        own = self.functions.get(path, ())
        if type(own) is tuple and len(own) > 8:
            own = self.functions[path] = Counter(own)
        return own[name] == 1 if type(own) is Counter else own.count(name) == 1

    def imports(self, module: str | None, plan: Plan, values: list) -> list[tuple]:
        """(state, path of the function, full name, path of the module) of every import."""
        if module is None:
            return [_UNBOUND] * len(plan.imports)
        out, modules = [], self.modules
        for by_import, imported, name, level in plan.imports:
            imported, name = values[imported], values[name]
            if by_import:
                hit, full = imported, imported
            elif level:
                found = candidates(module, imported, name, level, modules[module].endswith("__init__.py"))
                hit = next((x for x in found if x in modules), None)
            else:
                full = f"{imported}.{name}"
                hit = full if full in modules and name != "*" else imported
            path = modules.get(hit) if self.known else None
            if path is None:
                out.append(_UNBOUND if level else (_EXTERNAL, None, full, None))
                continue
            if not by_import and self.defines_once(path, name):
                out.append((_OWN, path, f"{hit}.{name}", path))
            else:
                out.append((_UNKNOWN, None, None, path))
        return out


def _grouped(files: DataFrame, scope: str, others: list[str], function, schema: str) -> DataFrame:
    return files.select(scope, "path", "content", *others).groupBy(scope).applyInArrow(function, schema)


def _batch(columns: list, types: list[pa.DataType], names: list[str], scope: pa.Scalar, at: int = 0) -> pa.RecordBatch:
    """``at``: where the scope stands among the columns; -1 if nowhere."""
    arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
    if at >= 0:
        arrays.insert(at, pa.repeat(scope, len(columns[0])))
    return pa.RecordBatch.from_arrays(arrays, names)


CALL = {"path": "string", "caller": "string", "callee": "string", "line_number": "int", "visit_ord": "int", "confidence": "string", "callee_qualified_name": "string", "target_path": "string"}
_ARROW = {"string": pa.string(), "int": pa.int32()}
_ROWS = 20_000


def resolved_calls(files: DataFrame, scope: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """``columns`` (all, if none) of ``scope`` and ``CALL`` of every call in ``files`` (scope, path, content), one row a file; see ``extract.resolve_calls``."""
    columns = columns or (scope, *CALL)
    wanted = [list(CALL).index(c) for c in columns if c != scope]
    types = [_ARROW[CALL[c]] for c in columns if c != scope]
    at = columns.index(scope) if scope in columns else -1
    kinds = CALL | {scope: dict(files.dtypes)[scope]}
    reader: list[Reader] = []

    def rows_of(own: _Repository) -> Iterator[tuple]:
        for path, module, plan, values, _ in own.files():
            if plan is None or not plan.calls:
                continue
            bound = [*own.imports(module, plan, values), _UNBOUND]  # -1 is the last
            for caller, callee, line, order, by_name, told, slot in plan.calls:
                state, target, full, _ = bound[slot]
                how = told[state]
                if how == "external" or how == "imported_local":
                    yield path, values[caller], values[callee], line, order, how, full if by_name else f"{full}.{values[callee]}", target if how == "imported_local" else None
                else:
                    yield path, values[caller], values[callee], line, order, how, None, None

    def confidences_of(own: _Repository) -> Iterator[tuple]:
        for _, module, plan, values, _ in own.files():
            if plan is not None and plan.calls:
                bound = [*own.imports(module, plan, values), _UNBOUND]
                yield from [(call[5][bound[call[6]][0]],) for call in plan.calls]

    only = columns == ("confidence",)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not reader:
            reader.append(Reader())
        rows = (confidences_of if only else rows_of)(_Repository(reader[0], batches, key[0].as_py() is not None))
        while part := list(islice(rows, _ROWS)):
            whole = list(zip(*part, strict=True))
            yield _batch(whole if only else [whole[i] for i in wanted], types, list(columns), key[0], at)

    return _grouped(files, scope, [], run, ", ".join(f"{c} {kinds[c]}" for c in columns))


COUNTS = ("i_n_in", "i_n_out", "c_n_in", "c_n_out")


def neighbours(files: DataFrame, scope: str, numbers: tuple[str, ...] = ()) -> DataFrame:
    """``scope, path`` and ``numbers`` of all ``files`` (scope, path, content and numbers) with how many others they import, are imported by, call and are called from.

    Calls count where they mean a function of another file for certain ('imported_local').
    """
    kinds, names = dict(files.dtypes), [scope, "path", *numbers, *COUNTS]
    types = [pa.string(), *[pa.int32()] * len(numbers), *[pa.int64()] * len(COUNTS)]
    reader: list[Reader] = []

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not reader:
            reader.append(Reader())
        own = _Repository(reader[0], batches, key[0].as_py() is not None)
        edges: tuple[dict, dict] = defaultdict(set), defaultdict(set)
        for path, module, plan, values, _ in own.files():
            if plan is None or not plan.imports or path is None:
                continue
            bound = own.imports(module, plan, values)
            edges[0][path].update(b[3] for b in bound if b[3] is not None and b[3] != path)
            for *_, told, slot in plan.calls:
                if slot >= 0 and (target := bound[slot][1]) is not None and target != path and told[_OWN] == "imported_local":
                    edges[1][path].add(target)
        ins = [Counter(t for targets in kind.values() for t in targets) for kind in edges]
        rows = []
        for path, _, _, _, rest in own.files():
            rows.append((path, *rest, ins[0][path], len(edges[0].get(path, ())), ins[1][path], len(edges[1].get(path, ()))))
            if len(rows) >= _ROWS:
                yield _batch(list(zip(*rows, strict=True)), types, names, key[0])
                rows = []
        if rows:
            yield _batch(list(zip(*rows, strict=True)), types, names, key[0])

    plain = files.select(scope, "path", "content", *[F.col(c).cast("int").alias(c) for c in numbers])
    return _grouped(plain, scope, list(numbers), run, f"{scope} {kinds[scope]}, path string, " + ", ".join([*(f"{c} int" for c in numbers), *(f"{c} long" for c in COUNTS)]))
