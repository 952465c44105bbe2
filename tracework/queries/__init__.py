"""Named queries over the driver tables, each with equivalent SQL."""

from __future__ import annotations

from . import artifacts, logs, repository, rules, scores, streams, texts

_MODULES = (streams, repository, texts, scores, logs, rules, artifacts)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}

#: Active windows of every user's event stream.
flagship = streams.active_windows
