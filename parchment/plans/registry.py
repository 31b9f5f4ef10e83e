"""All queries of the library and their SQL."""

from __future__ import annotations

from . import analysis, contracts, evaluation, findings, heavy, review

QUERIES = {**review.QUERIES, **evaluation.QUERIES, **heavy.QUERIES, **findings.QUERIES, **contracts.QUERIES, **analysis.QUERIES}
SQL = {**review.SQL, **evaluation.SQL, **heavy.SQL, **findings.SQL, **contracts.SQL, **analysis.SQL}
