"""The model of populations: which rates and sizes are estimated, equal, averaged or fixed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What the letters of a migration matrix say.
LETTERS = {"x": "free", "*": "free", "m": "mean", "s": "symmetric", "S": "symmetric product", "0": "zero", "c": "constant", "d": "divergence", "D": "divergence and migration"}


def parse_matrix(text: str, pops: int) -> list[dict]:
    """Rows (param_idx, kind, from_pop, to_pop, setting, rep_idx, estimated) of the n * n letters of a matrix, receiving
    population by row; other lower-case letters name groups of equal parameters. A member of a group, or one of a symmetric
    pair, is represented by the first; zeros and constants are not estimated."""
    letters = [c for c in text if not c.isspace() and c not in "{},;"]
    if len(letters) == 1:
        letters *= pops * pops
    if len(letters) != pops * pops:
        raise ValueError(f"{pops} populations need {pops * pops} letters, not {len(letters)}")
    order = [(i, i) for i in range(pops)] + [(j, i) for i in range(pops) for j in range(pops) if i != j]
    number = {p: k for k, p in enumerate(order)}
    first: dict[tuple, int] = {}
    rows = []
    for k, (source, to) in enumerate(order):
        c = letters[to * pops + source]
        kind = "theta" if source == to else "rate"
        setting = LETTERS.get(c, "group")
        key: tuple | None = None
        if setting in ("symmetric", "symmetric product") and kind == "rate":
            key = (setting, frozenset((source, to)))
        elif setting in ("mean", "group"):
            key = (setting, c, kind)
        rep = first.setdefault(key, k) if key else k
        rows.append({"param_idx": k, "kind": kind, "from_pop": source + 1, "to_pop": to + 1, "setting": setting, "rep_idx": rep, "estimated": setting not in ("zero", "constant")})
    assert len(number) == len(rows)
    return rows


def representatives(params: DataFrame, dim: DataFrame, on: str = "param_idx") -> DataFrame:
    """Rows of parameters that are estimated and stand for themselves or their group."""
    return params.join(dim.where((F.col("rep_idx") == F.col("param_idx")) & F.col("estimated")).select(F.col("param_idx").alias(on)), on, "left_semi")


def inherit(theta: Column, scalar: Column) -> Column:
    """A population size of a locus with another mode of inheritance."""
    return theta * scalar
