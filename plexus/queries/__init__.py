"""Every engine query with its SQL, by name."""

from . import compute, patterns, storage

QUERIES = {**patterns.QUERIES, **compute.QUERIES, **storage.QUERIES}
ORACLE = {**patterns.ORACLE, **compute.ORACLE, **storage.ORACLE}
