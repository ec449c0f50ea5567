"""The same tables as DuckDB common table expressions."""

from __future__ import annotations

from lingoloom.sources.tables import DRIVER, DUCK, SHARED, rendered


def with_tables(body: str) -> str:
    """Put the CTEs that a statement needs in front of it; it names them by their names."""
    wanted: list[str] = []

    def visit(name: str) -> None:
        if name in wanted:
            return
        for other in SHARED:
            if "{" + other + "}" in SHARED[name]:
                visit(other)
        wanted.append(name)

    for name in SHARED:
        if "{" + name + "}" in body:
            visit(name)
    text = body
    for name in (*SHARED, *DRIVER):
        text = text.replace("{" + name + "}", name)
    parts = [f"{n} AS ({rendered(n, lambda o: o, DUCK)})" for n in wanted]
    if not parts:
        return text
    head = "WITH " + ",\n".join(parts)
    stripped = text.lstrip()
    return head + (",\n" + stripped[5:] if stripped.upper().startswith("WITH ") else "\n" + stripped)
