"""Streams: the tallies and bursts of the batch operators, kept up to date as records arrive."""
