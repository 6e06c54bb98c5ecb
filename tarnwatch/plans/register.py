"""A decorator that registers a query with its SQL."""


def registry() -> tuple:
    queries, oracles = {}, {}

    def query(sql: str | None = None):
        def keep(f):
            queries[f.__name__] = f
            if sql is not None:
                oracles[f.__name__] = sql
            return f

        return keep

    return queries, oracles, query
