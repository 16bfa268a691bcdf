"""Name -> query and name -> SQL, filled by the query modules."""

QUERIES = {}
SQL = {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add
