"""Texts with named places, compiled once to a Column.

``{name}`` is a value, ``{#list}...{/list}`` is repeated for each entry of an array of structs, whose fields are the names within it (``{.}`` is an entry that is no struct),
and ``{{`` and ``}}`` stand for braces. A null value is an empty text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

_MARK = re.compile(r"\{\{|\}\}|\{([#/]?)([\w.]+)\}")

#: The documentation blocks of a class, a function and a method.
DOC_BLOCKS = {
    "class": "/**\n * {name}: A class that does things.\n *\n * @package Package\n **/\nclass {name} {{\n\t// body\n}}\n",
    "function": "/**\n * {name}: A function that does things.\n *\n * @return mixed\n **/\nfunction {name}(/* args */) {{\n\t// body\n}}\n",
    "method": "\t/**\n\t * {name}: A method that does things.\n\t *\n\t * @return mixed\n\t **/\n\tprivate function {name}() {{\n\t\t// body\n\t}}\n",
}
#: A note with front matter and its title as heading.
NOTE = "---\ntitle: '{title}'\ndescription: ''\ndate: {date}\nvisibility: private\nstatus: draft\ntags:\n{#tags}  - {.}\n{/tags}---\n# {title}\n"


def parse(template: str) -> list:
    """Texts, names and (list name, parts) in order; a part that is not closed, or closed but not open, is an error."""
    open_, at = [(None, [])], 0
    for m in _MARK.finditer(template):
        parts = open_[-1][1]
        parts.append(template[at : m.start()])
        at = m.end()
        if m[0] in ("{{", "}}"):
            parts.append(m[0][0])
        elif m[1] == "#":
            open_.append((m[2], []))
        elif m[1] == "/":
            name, inner = open_.pop()
            if name != m[2] or not open_:
                raise ValueError(f"{m[0]} closes nothing that is open")
            open_[-1][1].append((name, inner))
        else:
            parts.append((m[2], None))
    if len(open_) > 1:
        raise ValueError(f"{{#{open_[-1][0]}}} is not closed")
    return [*open_[0][1], template[at:]]


def _joined(parts: list, value) -> Column:
    shown = []
    for p in parts:
        if isinstance(p, str):
            shown += [F.lit(p)] if p else []
        elif p[1] is None:
            shown.append(F.coalesce(value(p[0]).cast("string"), F.lit("")))
        else:
            inner = p[1]
            each = lambda x, inner=inner: _joined(inner, lambda n: x if n == "." else x[n])
            shown.append(F.coalesce(F.array_join(F.transform(value(p[0]), _one(each)), ""), F.lit("")))
    return F.concat(*shown) if shown else F.lit("")


def _one(f):
    return lambda x: f(x)


def render(template: str, values: dict[str, Column]) -> Column:
    """The template with its values; a name without a value is an error."""
    def value(name):
        if name not in values:
            raise KeyError(f"the template has a place {name}, but there is no such value")
        return values[name]

    return _joined(parse(template), value)


def doc_block(kind: str, name: Column) -> Column:
    """The documentation block of a class, function or method of this name."""
    return render(DOC_BLOCKS[kind], {"name": name})
