"""Queries and their SQL, kept side by side."""

from __future__ import annotations


def book():
    """(queries, sql, query): ``@query(sql)`` registers a function under its name; without SQL only its rows are checked."""
    queries, sql_of = {}, {}

    def query(sql=None):
        def keep(function):
            queries[function.__name__] = function
            if sql:
                sql_of[function.__name__] = sql
            return function

        return keep

    return queries, sql_of, query
