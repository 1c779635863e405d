"""Every registered relational query with its DuckDB text."""

from __future__ import annotations

from functools import partial

from .relational import FRAMES, SQL, run
from .warehouse import ANALYZE_SQL, EFFECTS, analyze_stats, effect


def _dialect(text: str):
    return lambda spark, sf_dir: run(spark, sf_dir, text)


QUERIES = {
    **{k: _dialect(text) for k, (text, _) in SQL.items()},
    **{k: f for k, (f, _) in FRAMES.items()},
    **{k: partial(lambda name, spark, sf_dir: effect(name)(spark, sf_dir), k) for k in EFFECTS},
    "analyze_stats": analyze_stats,
}
ORACLE_SQL = {
    **{k: duck or text for k, (text, duck) in SQL.items()},
    **{k: sql for k, (_, sql) in FRAMES.items()},
    **{k: sql for k, (_, _, sql) in EFFECTS.items()},
    "analyze_stats": ANALYZE_SQL,
}
