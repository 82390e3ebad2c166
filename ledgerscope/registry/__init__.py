"""Named queries over an input folder. Every query takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from ledgerscope.registry import relational, reporting, segments


def all_queries() -> dict:
    out: dict = {}
    for module in (relational, reporting, segments):
        for name, build in module.QUERIES.items():
            if name in out:
                raise ValueError(f"query {name} is registered twice")
            out[name] = build
    return out
