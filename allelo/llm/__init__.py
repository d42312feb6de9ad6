"""Operators of a training-data pipeline over documents; nothing else in the library imports this subpackage."""


def queries() -> dict:
    from .contracts import QUERIES

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return dict(ORACLES)
