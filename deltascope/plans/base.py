"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from . import roles


def registrar(book: dict) -> Callable:
    """A decorator factory: ``@query(sql, roles=True)`` puts the function and its SQL into ``book`` by its name."""

    def query(sql: str | None = None, with_roles: bool = True) -> Callable:
        def keep(build: Callable) -> Callable:
            text = sql
            if sql and with_roles:
                text = roles.SQL + (", " + sql.strip()[5:] if sql.strip().upper().startswith("WITH ") else sql)
            book[build.__name__] = (build, text)
            return build

        return keep

    return query
