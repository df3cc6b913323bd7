"""The queries of this subpackage and their SQL."""

from emberlane.llm import bpe, chat, html, language, near_dup, packing, quality, rans, spelling, suffixes, toxicity, vectors, whitening

_MODULES = [language, toxicity, bpe, rans, html, quality, packing, chat, near_dup, vectors, whitening, spelling, suffixes]

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
