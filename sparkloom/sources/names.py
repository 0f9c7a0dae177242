"""Reversible encoding of project, dataset and table names into Spark's session catalog.

Spark allows ``[a-z0-9_]`` there and folds case.  Any other character becomes ``_x`` and
its code point in hex, closed by ``_``; a project and a dataset are joined by ``__``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

_PLAIN = re.compile(r"[a-z0-9]")


def encode(name: str) -> str:
    out = []
    for i, c in enumerate(name):
        around = _PLAIN.match(name[i - 1 : i]) and _PLAIN.match(name[i + 1 : i + 2]) and name[i + 1] != "x" if c == "_" and i else None
        out.append(c if _PLAIN.match(c) or around else f"_x{ord(c):x}_")
    return "".join(out)


def decode(name: str) -> str:
    return re.sub(r"_x([0-9a-f]+)_", lambda m: chr(int(m[1], 16)), name)


def database(project: str, dataset: str) -> str:
    return f"p_{encode(project)}__{encode(dataset)}"


def undatabase(db: str) -> tuple[str, str] | None:
    """(project, dataset) of a database made by :func:`database`, else None."""
    if not db.startswith("p_"):
        return None
    # an encoded name never holds "__" but in an escape that opens or closes there
    parts = re.fullmatch(r"p_((?:[a-z0-9]|_x[0-9a-f]+_|_(?!_|x))+?)__((?:[a-z0-9]|_x[0-9a-f]+_|_(?!_|x))+)", db)
    return (decode(parts[1]), decode(parts[2])) if parts else None


def quote(*parts: str) -> str:
    return ".".join("`" + p.replace("`", "``") + "`" for p in parts)


@dataclass(frozen=True)
class Scope:
    """Where names without project or dataset belong."""

    project: str = "local"
    dataset: str = "local"

    def resolve(self, parts: list[str]) -> tuple[str, str, str]:
        """(project, dataset, table) of one to three name parts."""
        if len(parts) > 3:
            parts = [".".join(parts[:-2]), *parts[-2:]]
        return (*(self.project, self.dataset)[: 3 - len(parts)], *parts)  # type: ignore[return-value]

    def table(self, parts: list[str]) -> str:
        p, d, t = self.resolve(parts)
        return quote(database(p, d), encode(t))

    def schema(self, parts: list[str]) -> str:
        p, d = (self.project, parts[0]) if len(parts) == 1 else (".".join(parts[:-1]), parts[-1])
        return quote(database(p, d))

    def at(self, project: str | None = None, dataset: str | None = None) -> "Scope":
        return replace(self, project=project or self.project, dataset=dataset or self.dataset)
