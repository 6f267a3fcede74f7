"""All queries of the engine's own operators, with the SQL that gives the same rows."""

from . import corpus, evaluation, files, findings, groups, relational

_FAMILIES = (evaluation, corpus, groups, findings, relational, files)
QUERIES: dict = {name: f for m in _FAMILIES for name, f in m.R.queries.items()}
ORACLES: dict[str, str] = {name: sql for m in _FAMILIES for name, sql in m.R.oracles.items()}
