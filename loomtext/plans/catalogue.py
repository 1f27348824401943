"""All queries of the core, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from loomtext.plans import texts, cleaning, language_models, sequences, labels, vectors, retrieval  # noqa: I001

PARTS = (texts, cleaning, language_models, sequences, labels, vectors, retrieval)


def queries() -> dict[str, Callable]:
    return {k: v for part in PARTS for k, v in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for part in PARTS for k, v in part.SQL.items()}
