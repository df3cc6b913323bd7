"""Evidence analytics on Spark: scans, rules, joins, ranking, verification and metrics."""
