"""All queries of the engine by name, with the SQL that checks them."""

from __future__ import annotations

from leafstrata.plans import queries
from leafstrata.plans.oracle import ORACLE_SQL

#: Queries that SQL can't express are compared with brute force in the tests.
UNCHECKED = ("inpaint_fill", "gaussian_blur", "background_layer")
QUERIES = {name: getattr(queries, name) for name in (*ORACLE_SQL, *UNCHECKED)}
