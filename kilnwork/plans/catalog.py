"""All registered queries of the engine's own operators, and the SQL that says what each means."""

from __future__ import annotations

from kilnwork.plans import contest, documents, known, lifecycle, relational

QUERIES = {**relational.QUERIES, **documents.QUERIES, **lifecycle.QUERIES, **known.QUERIES, **contest.QUERIES}
SQL = {**relational.SQL, **documents.SQL, **lifecycle.SQL, **known.SQL, **contest.SQL}
