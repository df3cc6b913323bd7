"""All queries of the engine's own operators, with their SQL."""

from emberlane.plans import behaviour, campaign, delivery, extras, hives, joins, knowledge, layouts, logs, modeltext, objects, ordered, prefetches, proposals, records, rulebook, scans, streams, verdicts, wallclock

_MODULES = [campaign, delivery, extras, hives, joins, knowledge, layouts, logs, modeltext, objects, ordered, records, verdicts, proposals, streams, scans, logs, hives, prefetches, behaviour, objects, modeltext, knowledge, rulebook, wallclock, layouts]

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
