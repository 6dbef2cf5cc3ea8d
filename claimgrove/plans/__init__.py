"""Composite jobs: the user-facing entry points built from the operators."""

from claimgrove.plans.jobs import (
    check_numbers,
    evaluate_model,
    extract_observations,
    grade_claims,
    reconcile_disclosures,
    retrieve,
)

__all__ = [
    "check_numbers",
    "evaluate_model",
    "extract_observations",
    "grade_claims",
    "reconcile_disclosures",
    "retrieve",
]
