"""All queries of the core, and their SQL."""

from __future__ import annotations

from orbitlake.plans import chemistry, files, molecules, more, problems

QUERIES = {**molecules.QUERIES, **chemistry.QUERIES, **more.QUERIES, **files.QUERIES, **problems.QUERIES}
SQL: dict[str, str] = {**molecules.SQL, **chemistry.SQL, **more.SQL, **files.SQL, **problems.SQL}
