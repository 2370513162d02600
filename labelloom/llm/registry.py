"""Queries of this subpackage: name -> callable, and the equivalent SQL where SQL can say it."""

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add
