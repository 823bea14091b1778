"""Queries over streams.

The dialect is a batch one. What keeps no state across rows, projections and filters, has
the same meaning on a stream; `continuous` runs such a query and refuses all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..engine import Engine
from ..plans import logical as L
from ..plans.errors import unsupported


def _stateless(rel: L.Rel) -> bool:
    own = isinstance(rel, (L.Scan, L.Filter, L.Project)) or isinstance(rel, L.SetOp) and rel.op == "union" and rel.every
    return own and not any(True for x in rel.exprs() for _ in L.subqueries(x)) and all(map(_stateless, rel.inputs()))


def continuous(engine: Engine, text: str) -> DataFrame:
    """The result of a stateless query over registered streams, as a streaming DataFrame."""
    if not _stateless(engine.bind(text).rel):
        raise unsupported("a query on a stream that needs more than the row at hand")
    return engine.sql(text)
