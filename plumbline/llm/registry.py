"""The queries of this subpackage and, where SQL can express one, its DuckDB text."""

from . import bpe, decontam, licenses, lm, near, quality, rules, secrets, suffix, warc

MODULES = [suffix, decontam, licenses, lm, bpe, secrets, quality, rules, warc, near]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
