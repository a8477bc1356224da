"""What the names of a file's functions hold, as steps that joins can follow.

A file alone doesn't say which class ``x`` is in ``x = make().part``: that takes
other files. So each name is written as a step over other steps, and
``receivers`` works the steps off:

* ``known``: the class whose method it is (name)
* ``said``: the one class among those that an annotation names (name: dotted, by commas)
* ``made``: what a call of a dotted name gives (name)
* ``super``: what a method behind a class gives (name: class and method)
* ``attr``, ``result``: an attribute, or what a method gives, of a step (name)
* ``first``: the first of its steps that is a class; ``one``: the class of its steps, if they agree
* ``slot``: ``one`` for an attribute of a class (name: class and attribute)

A name that is bound but holds nothing known is in the environment as None: it
hides what the module calls by that name. A name bound several times holds, at
each place, what the bindings up to there agree on; calls see the last. Functions
see the names of those that they stand in.
"""

from __future__ import annotations

import ast

FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
SCOPES = (*FUNCTIONS, ast.ClassDef, ast.Lambda)


def dotted(node) -> str | None:
    """``a.b.c`` of plain names."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


def members(annotation) -> list[str]:
    """The dotted names that an annotation allows: itself, or those of its optional and union types."""
    if isinstance(annotation, ast.Constant) and isinstance(annotation.value, str):
        try:
            annotation = ast.parse(annotation.value, mode="eval").body
        except (SyntaxError, ValueError):
            return []
    if isinstance(annotation, ast.BinOp) and isinstance(annotation.op, ast.BitOr):
        return members(annotation.left) + members(annotation.right)
    if isinstance(annotation, ast.Subscript):
        if (dotted(annotation.value) or "").rpartition(".")[2] not in ("Optional", "Union"):
            return []
        inner = annotation.slice.elts if isinstance(annotation.slice, ast.Tuple) else [annotation.slice]
        return [m for part in inner for m in members(part)]
    name = dotted(annotation)
    return [name] if name else []


def decorators(node) -> set[str]:
    """Last names of a function's decorators."""
    plain = [d.func if isinstance(d, ast.Call) else d for d in node.decorator_list]
    return {(dotted(d) or getattr(d, "attr", "")).rpartition(".")[2] for d in plain}


def is_static(node) -> bool:
    return "staticmethod" in decorators(node)


def within(body):
    """Nodes of a body in order, scopes themselves included but not what stands in them."""
    todo = list(reversed(body))
    while todo:
        node = todo.pop()
        yield node
        if not isinstance(node, SCOPES):
            todo.extend(reversed(list(ast.iter_child_nodes(node))))


def bindings(body):
    """(name, value, annotation) of what a body binds, in order; value None where a name gets part of one."""
    for node in within(body):
        if isinstance(node, ast.Assign):
            pairs = [(t, node.value, None) for t in node.targets]
        elif isinstance(node, ast.AnnAssign):
            pairs = [(node.target, node.value, node.annotation)] if isinstance(node.target, ast.Name) else []
        elif isinstance(node, (ast.With, ast.AsyncWith)):
            pairs = [(i.optional_vars, i.context_expr, None) for i in node.items if i.optional_vars is not None]
        elif isinstance(node, (ast.For, ast.AsyncFor)):
            pairs = [(node.target, None, None)]
        elif isinstance(node, ast.ExceptHandler) and node.name:
            yield node.name, None, None
            continue
        else:
            continue
        for target, value, annotation in pairs:
            if isinstance(target, ast.Name):
                yield target.id, value, annotation
            else:  # part of a value, or a place in something: its names count as bound
                for part in ast.walk(target):
                    if isinstance(part, ast.Name):
                        yield part.id, None, None


def evaluated(nodes):
    """Calls in order of evaluation: what stands inside a call comes before it. Bodies of functions wait."""
    for node in nodes:
        if not isinstance(node, FUNCTIONS):
            yield from evaluated(ast.iter_child_nodes(node))
            if isinstance(node, ast.Call):
                yield node


class Flow:
    """Steps and call sites of one file."""

    def __init__(self):
        self.steps: list[tuple] = []  # (kind, name, steps it needs)
        self.sites: dict[str, list] = {}  # function: [(last name, mode, reference, line, end)]
        self.slots: list[tuple] = []  # (class, attribute, step)
        self._ids: dict[tuple, int] = {}
        self._seen: dict[int, dict] = {}

    def step(self, kind: str, name: str | None = None, needs: tuple[int, ...] = ()) -> int:
        key = (kind, name, needs)
        if key not in self._ids:
            self._ids[key] = len(self.steps)
            self.steps.append(key)
        return self._ids[key]

    def one(self, steps) -> int | None:
        some = tuple(sorted({s for s in steps if s is not None}))
        return self.step("one", None, some) if len(some) > 1 else some[0] if some else None

    def first(self, a: int | None, b: int | None) -> int | None:
        if a is None or b is None or a == b:
            return b if a is None else a
        return self.step("first", None, (a, b))

    def said(self, annotation) -> int | None:
        some = members(annotation) if annotation is not None else []
        return self.step("said", ",".join(dict.fromkeys(some))) if some else None

    def value(self, node, env: dict, holder: str | None) -> int | None:
        """The step that an expression's value is, if one can tell."""
        if isinstance(node, ast.Name):
            return env.get(node.id)
        if isinstance(node, ast.Await):
            return self.value(node.value, env, holder)
        if isinstance(node, ast.Attribute):
            base = self.value(node.value, env, holder)
            return None if base is None else self.step("attr", node.attr, (base,))
        if isinstance(node, ast.Call) and (site := self.site(node.func, env, holder)):
            last, mode, ref = site
            if mode == "static":
                return self.step("made", ref)
            if mode == "super":
                return self.step("super", f"{ref}.{last}")
            if mode == "path":
                return self.step("result", last, (ref,))
        return None

    def site(self, func, env: dict, holder: str | None) -> tuple | None:
        """(last name, mode, reference) of what is called: a dotted name (``static``), a method of a step (``path``) or behind a class (``super``), or nothing known (``bare``)."""
        if isinstance(func, ast.Name):
            return (func.id, "bare", None) if func.id in env else (func.id, "static", func.id)
        if not isinstance(func, ast.Attribute):
            return None
        on = func.value
        if isinstance(on, ast.Call) and isinstance(on.func, ast.Name) and on.func.id == "super":
            return (func.attr, "super", holder) if holder else (func.attr, "bare", None)
        base = self.value(on, env, holder)
        if base is not None:
            return func.attr, "path", base
        name = dotted(on)
        if name and name.partition(".")[0] not in env:
            return func.attr, "static", f"{name}.{func.attr}"
        return func.attr, "bare", None

    def names(self, node, holder: str | None, env: dict) -> dict:
        """What the names in function ``node`` hold; ``holder``: the class whose method it is."""
        if not env and id(node) in self._seen:
            return self._seen[id(node)]
        args = node.args
        positional = [*args.posonlyargs, *args.args]
        held = {a.arg: [self.said(a.annotation)] for a in (*positional, args.vararg, *args.kwonlyargs, args.kwarg) if a}
        if holder and positional and not is_static(node):
            held[positional[0].arg] = [self.step("known", holder)]
        found = env | {name: self.one(steps) for name, steps in held.items()}
        for name, value, annotation in bindings(node.body):
            steps = held.setdefault(name, [])
            steps.append(self.first(self.said(annotation), self.value(value, found, holder)))
            found[name] = self.one(steps)
        if not env:
            self._seen[id(node)] = found
        return found

    def function(self, node, path: list[str], holder: str | None, is_method: bool, env: dict) -> None:
        env = self.names(node, holder if is_method else None, env)
        name = ".".join([*path, node.name])
        sites = {}
        for call in evaluated(node.body):
            if site := self.site(call.func, env, holder):
                if site[1:] != ("static", "super"):
                    sites.setdefault(site, None)
        self.sites[name] = [(*site, node.lineno, node.end_lineno) for site in sites]
        self.scope(node.body, [*path, node.name], holder, True, env)

    def scope(self, body, path: list[str], holder: str | None, inside: bool, env: dict) -> None:
        """Functions and classes that stand in ``body``; ``inside`` a function methods have no receiver."""
        for node in within(body):
            if isinstance(node, FUNCTIONS):
                self.function(node, path, holder, not inside and holder is not None, env)
            elif isinstance(node, ast.ClassDef):
                self.scope(node.body, [*path, node.name], None if path else node.name, inside, env)

    def attributes(self, node) -> None:
        """Slots of a top-level class: from its body and from its methods' assignments to their receiver."""
        held: dict[str, list] = {}
        for item in node.body:
            if isinstance(item, ast.AnnAssign) and isinstance(item.target, ast.Name):
                held.setdefault(item.target.id, []).append(self.said(item.annotation))
            elif isinstance(item, ast.Assign):
                for target in item.targets:
                    if isinstance(target, ast.Name):
                        held.setdefault(target.id, []).append(self.value(item.value, {}, None))
        for method in {m.name: m for m in node.body if isinstance(m, FUNCTIONS)}.values():
            positional = [*method.args.posonlyargs, *method.args.args]
            if not positional or is_static(method):
                continue
            env = self.names(method, node.name, {})
            for item in within(method.body):
                if not isinstance(item, (ast.Assign, ast.AnnAssign)):
                    continue
                for target in item.targets if isinstance(item, ast.Assign) else [item.target]:
                    if isinstance(target, ast.Attribute) and isinstance(target.value, ast.Name) and target.value.id == positional[0].arg:
                        said = self.said(getattr(item, "annotation", None))
                        held.setdefault(target.attr, []).append(self.first(said, self.value(item.value, env, node.name)))
        for name, steps in held.items():
            if some := tuple(sorted({s for s in steps if s is not None})):
                self.slots.append((node.name, name, self.step("slot", f"{node.name}.{name}", some)))

    def rows(self, tree):
        """Facts ``call``, ``slot``, ``returns`` and ``step`` of a module; steps that nothing asks for are left out."""
        top = {n.name: n for n in tree.body if isinstance(n, (*FUNCTIONS, ast.ClassDef))}
        for node in top.values():
            if isinstance(node, ast.ClassDef):
                self.attributes(node)
        self.scope(tree.body, [], None, False, {})
        asked = [step for _, _, step in self.slots]
        for function, sites in self.sites.items():
            for k, (last, mode, ref, line, end) in enumerate(sites):
                asked += [ref] if mode == "path" else []
                yield "call", k, last, function, None if ref is None else str(ref), line, end, mode
        for cls, name, step in self.slots:
            yield "slot", step, name, cls, None, 0, 0, None
        for node in top.values():
            for function in [node] if isinstance(node, FUNCTIONS) else {m.name: m for m in node.body if isinstance(m, FUNCTIONS)}.values():
                if (step := self.said(function.returns)) is not None:
                    asked.append(step)
                    yield "returns", step, function.name, function.name if function is node else f"{node.name}.{function.name}", None, function.lineno, function.end_lineno, None
        kept = set()
        while asked:
            if (step := asked.pop()) not in kept:
                kept.add(step)
                asked += self.steps[step][2]
        for step in sorted(kept):
            kind, name, needs = self.steps[step]
            yield "step", step, name, None, ",".join(map(str, needs)) or None, 0, 0, kind
