"""Independent SQL for checking query results."""

from __future__ import annotations


def statements() -> dict[str, str]:
    """Query name -> complete DuckDB statement."""
    from oracle.base import full
    from oracle.relational import SQL
    from oracle.reports import PORTFOLIO, REPORTS
    from oracle.segments import SEGMENT_SQL

    plain = {**SQL, **{f"report_{name}": sql for name, sql in REPORTS.items()}, **PORTFOLIO, **SEGMENT_SQL}
    return {name: full(sql) for name, sql in plain.items()}
