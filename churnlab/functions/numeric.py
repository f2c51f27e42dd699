"""Numeric helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rnd(c: Column | str, digits: int) -> Column:
    """Round half up and fold -0.0 into 0.0 (so equal results compare equal)."""
    return F.round(c, digits) + F.lit(0.0)


def wrap_sql_rounds(sql: str) -> str:
    """Rewrite every ``round(...)`` of a SQL string as ``(round(...) + 0.0)``."""
    out, i, key = [], 0, "round("
    while True:
        j = sql.find(key, i)
        if j < 0 or (j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i:j + len(key)])
            i = j + len(key)
            continue
        depth, k = 0, j + len(key) - 1
        while True:
            ch = sql[k]
            depth += ch == "("
            depth -= ch == ")"
            if depth == 0:
                break
            k += 1
        inner = wrap_sql_rounds(sql[j + len(key):k])
        out.append(sql[i:j] + "(round(" + inner + ") + 0.0)")
        i = k + 1
