"""Name -> Spark callable and name -> SQL."""

from .fixtures import CTES

QUERIES, SQL = {}, {}


def query(name, sql=None, uses=()):
    """Register a query; ``uses`` names fixture tables put in front of ``sql``."""
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = with_tables(uses, sql)
        return fn

    return wrap


def with_tables(uses, sql):
    need, seen = [], set()

    def add(n):
        if n in seen:
            return
        seen.add(n)
        deps, _ = CTES[n]
        for d in deps:
            add(d)
        need.append(n)

    for u in uses:
        add(u)
    if not need:
        return sql
    body = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in need)
    for head in ("WITH RECURSIVE ", "WITH "):
        if sql.startswith(head):
            return f"{head}{body}\n, {sql[len(head):]}"
    return f"WITH {body}\n{sql}"
