"""All queries of the library and the SQL they are held against."""

from __future__ import annotations

from millrace.plans import corpus, formats, more  # noqa: F401  (they add their queries to those of corpus)

QUERIES = dict(corpus.QUERIES)
ORACLES = dict(corpus.ORACLES)
