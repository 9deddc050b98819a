"""Every statement by query name."""

from importlib import import_module


def decimal(sql: str, tail: str = ", 6)") -> str:
    """Rounds to six digits from decimals, as the queries do."""
    out, at = "", 0
    while (found := sql.find("round(", at)) >= 0:
        depth, end = 1, found + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inner = sql[found + 6:end]
        if inner.endswith(tail):
            inner = f"TRY_CAST({decimal(inner[:-len(tail)])} AS DECIMAL(38, 10)){tail}::DOUBLE"
        else:
            inner = decimal(inner)
        out, at = f"{out}{sql[at:found]}round({inner}", end
    return out + sql[at:]


ORACLES: dict[str, str] = {}
for _part in ("series", "rounds", "scores", "rankings", "history", "writes", "sources", "streams"):
    ORACLES.update({name: decimal(sql) for name, sql in import_module(f"oracles.{_part}").ORACLES.items()})
