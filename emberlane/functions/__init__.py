"""Column builders: text, time, network and comparison functions; no Python runs per row."""
