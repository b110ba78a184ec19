"""Names of the engine's own queries, with the SQL that should give the same rows."""

from __future__ import annotations

from lodestone.plans import code, corpus, events, graphs, names, project, texts, web

MODULES = (graphs, names, texts, events, web, code, corpus, project)
QUERIES: dict = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for m in MODULES for k, v in m.ORACLES.items()}
