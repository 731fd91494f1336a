"""Models as a graph: registration, selection, build with tests, layer lint, lineage, and write-audit-publish."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame

from tidemark.sources.tables import Backfill, Catalog, CatalogError, ReferenceConflict

LAYERS = ("bronze", "staging", "silver", "gold")


@dataclass
class Model:
    """A named DataFrame function; needs are the models or bronze tables that it reads, in the order of its arguments."""

    name: str
    build: Callable[..., DataFrame]
    needs: tuple[str, ...] = ()
    layer: str = "silver"
    materialized: str = "table"
    keys: tuple[str, ...] = ()
    tests: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)
    takes_vars: bool = False


@dataclass
class Result:
    name: str
    status: str
    failures: dict[str, int] = field(default_factory=dict)
    error: str = ""


class Project:
    """Models and how they hang together."""

    def __init__(self) -> None:
        self.models: dict[str, Model] = {}

    def model(self, needs: tuple[str, ...] = (), **how) -> Callable:
        """Decorator: register a function as the model of its name."""

        def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            name = how.pop("name", f.__name__)
            if name in self.models:
                raise ValueError(f"model {name} exists")
            self.models[name] = Model(name, f, needs, **how)
            return f

        return add

    def order(self) -> list[str]:
        """All models, each after what it needs."""
        out: list[str] = []
        state: dict[str, int] = {}

        def visit(n: str) -> None:
            if n not in self.models or state.get(n) == 2:
                return
            if state.get(n) == 1:
                raise ValueError(f"cycle through {n}")
            state[n] = 1
            for d in self.models[n].needs:
                visit(d)
            state[n] = 2
            out.append(n)

        for n in sorted(self.models):
            visit(n)
        return out

    def downstream(self, name: str) -> set[str]:
        found = {name}
        for n in self.order():
            if found & set(self.models[n].needs):
                found.add(n)
        return found

    def select(self, what: str | None = None) -> list[str]:
        """``name``, ``name+`` for it and all after it, and ``a,b`` for what both select; parted by spaces, a union. None is everything."""
        if not what:
            return self.order()

        def one(term: str) -> set[str]:
            name = term.rstrip("+")
            if name.startswith("layer:"):
                return {n for n, m in self.models.items() if m.layer == name[6:]}
            if name not in self.models:
                raise ValueError(f"no model {name}")
            return self.downstream(name) if term.endswith("+") else {name}

        chosen: set[str] = set()
        for part in what.split():
            chosen |= set.intersection(*(one(t) for t in part.split(",")))
        return [n for n in self.order() if n in chosen]

    def lint(self) -> list[str]:
        """Edges that break the layers: only staging reads bronze, and nothing reads a later layer."""
        rank = {x: i for i, x in enumerate(LAYERS)}
        bad = []
        for m in self.models.values():
            for d in m.needs:
                layer = self.models[d].layer if d in self.models else "bronze"
                if layer == "bronze" and m.layer != "staging" or rank[layer] > rank[m.layer]:
                    bad.append(f"{m.layer} {m.name} reads {layer} {d}")
        return bad

    # execution

    def read(self, catalog: Catalog, name: str, variables: dict | None = None) -> DataFrame:
        """A model's table, or for a view its rows computed now."""
        m = self.models.get(name)
        if m and m.materialized == "view":
            return self._build(catalog, m, variables or {})
        return catalog.table(name)

    def _build(self, catalog: Catalog, m: Model, variables: dict) -> DataFrame:
        args = [self.read(catalog, d, variables) for d in m.needs]
        return m.build(*args, variables) if m.takes_vars else m.build(*args)

    def run(self, catalog: Catalog, select: str | None = None, variables: dict | None = None, full_refresh: bool = False) -> list[Result]:
        """Build the selected models in order; what needs a failed model is skipped."""
        return self._each(catalog, select, variables, full_refresh, True, False)

    def test(self, catalog: Catalog, select: str | None = None, variables: dict | None = None) -> list[Result]:
        return self._each(catalog, select, variables, False, False, True)

    def build(self, catalog: Catalog, select: str | None = None, variables: dict | None = None, full_refresh: bool = False) -> list[Result]:
        """run and test node by node: a model is tested before any that needs it is built."""
        return self._each(catalog, select, variables, full_refresh, True, True)

    def _each(self, catalog: Catalog, select: str | None, variables: dict | None, full: bool, run: bool, test: bool) -> list[Result]:
        variables, out, bad = variables or {}, [], set()
        for name in self.select(select):
            m = self.models[name]
            if bad & set(m.needs):
                bad.add(name)
                out.append(Result(name, "skipped"))
                continue
            r = Result(name, "ok")
            try:
                if run and m.materialized != "view":
                    self._store(catalog, m, self._build(catalog, m, variables), variables, full)
                if test and m.tests:
                    rows = self.read(catalog, name, variables)
                    r.failures = {t: n for t, f in m.tests.items() if (n := f(rows).count())}
                    r.status = "failed" if r.failures else "ok"
            except Exception as e:
                r.status, r.error = "error", str(e)
            if r.status != "ok":
                bad.add(name)
            out.append(r)
        return out

    @staticmethod
    def _store(catalog: Catalog, m: Model, df: DataFrame, variables: dict, full: bool) -> None:
        if m.materialized == "table" or full or not catalog.exists(m.name):
            catalog.overwrite(m.name, df)
        elif m.materialized == "incremental":
            catalog.merge(m.name, df, list(m.keys))
        elif m.materialized == "watermark":
            window = variables.get("backfill")
            catalog.incremental(m.name, df, list(m.keys), backfill=Backfill(*window) if window else None)
        else:
            raise ValueError(f"unknown materialization {m.materialized}")

    # lineage

    def graph(self) -> str:
        """The models as a Mermaid flowchart, grouped by layer."""
        lines = ["flowchart LR"]
        for layer in LAYERS:
            names = [m.name for m in self.models.values() if m.layer == layer]
            if names:
                lines += [f"  subgraph {layer}", *(f"    {_safe(n)}[{n}]" for n in sorted(names)), "  end"]
        return "\n".join([*lines, *(f"  {_safe(d)} --> {_safe(n)}" for n in self.order() for d in self.models[n].needs)])


def _safe(name: str) -> str:
    return re.sub(r"\W", "_", name)


def column_lineage(df: DataFrame, **inputs: DataFrame) -> dict[str, set[str]]:
    """Which input columns each column of df comes from, found in its analyzed plan by attribute ids."""
    plan = df._jdf.queryExecution().analyzed()
    source: dict[int, str] = {}
    for name, x in inputs.items():
        for a in _list(x._jdf.queryExecution().analyzed().output()):
            source[a.exprId().id()] = f"{name}.{a.name()}"
    made: dict[int, set[int]] = {}

    def refs(e) -> set[int]:
        return {a.exprId().id() for a in _list(e.references().toSeq())}

    def walk(p) -> None:
        for c in _list(p.children()):
            walk(c)
        for e in _list(p.expressions()):
            stack = [e]
            while stack:
                x = stack.pop()
                if x.getClass().getSimpleName() == "Alias":
                    made.setdefault(x.exprId().id(), set()).update(refs(x))
                stack += _list(x.children())
        if p.getClass().getSimpleName() == "Union":
            outs = _list(p.output())
            for c in _list(p.children()):
                for o, i in zip(outs, _list(c.output()), strict=True):
                    made.setdefault(o.exprId().id(), set()).add(i.exprId().id())

    walk(plan)

    def origins(k: int, seen: set[int]) -> set[str]:
        if k in source:
            return {source[k]}
        if k in seen:
            return set()
        return set().union(*(origins(x, seen | {k}) for x in made.get(k, ()) if x != k))

    return {a.name(): origins(a.exprId().id(), set()) for a in _list(plan.output())}


def _list(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


@dataclass
class Published:
    """exit_code: 0 published, 2 nothing selected, 3 no branch, 4 write failed, 5 audit failed, 6 merge conflict, 7 merge failed, 8 branch not deleted."""

    exit_code: int
    branch: str | None
    results: list[Result]


def write_audit_publish(project: Project, catalog: Catalog, select: str, variables: dict | None = None, prefix: str = "wap", keep: bool = False) -> Published:
    """Build the selected models on a branch of their own, test them there, and merge the branch only if all tests pass.

    A branch that does not pass stays for inspection, and readers of the main branch never see it.
    """
    if variables is not None and not isinstance(variables, dict):
        raise TypeError("variables must be a dict")
    try:
        names = project.select(select)
    except ValueError:
        names = []
    if not names:
        return Published(2, None, [])
    head = catalog.get_reference("main")
    branch = f"{prefix}_{datetime.now(UTC):%Y%m%d%H%M%S}_{uuid.uuid4().hex[:8]}"
    try:
        catalog.create_branch(branch, "main")
    except CatalogError:
        return Published(3, None, [])
    there = catalog.at(branch)
    results = project.run(there, select, variables)
    if any(r.status != "ok" for r in results):
        return Published(4, branch, results)
    results += project.test(there, select, variables)
    if any(r.status != "ok" for r in results):
        return Published(5, branch, results)
    try:
        done = catalog.merge_branch(branch, "main", head.hash)
    except ReferenceConflict:
        return Published(6, branch, results)
    if not done.was_successful:
        return Published(7, branch, results)
    if not keep:
        try:
            catalog.delete_reference(branch, there.get_reference().hash)
        except CatalogError:
            return Published(8, branch, results)
    return Published(0, branch if keep else None, results)
