"""Where queries and their SQL are registered."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    """Register a function (spark, sf_dir) -> DataFrame under its name; ``views`` are the WITH terms of its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            terms = [*views]
            body = sql.strip()
            if body.upper().startswith("WITH RECURSIVE "):
                body = "WITH RECURSIVE " + ", ".join([*terms, body[len("WITH RECURSIVE ") :]])
            elif body.upper().startswith("WITH "):
                body = "WITH " + ", ".join([*terms, body[len("WITH ") :]])
            elif terms:
                body = "WITH " + ", ".join(terms) + " " + body
            SQL[f.__name__] = body
        return f

    return add
