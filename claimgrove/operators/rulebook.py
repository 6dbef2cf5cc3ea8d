"""Pinned rule tables of the three claim tracks (fixed values)."""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values: grades, labels, elements, branches ---------------------------------
GRADES = ("E0", "E1", "E2", "E3")
LABELS = {
    "E0": "UNSUBSTANTIATED",
    "E1": "INCOMPLETE",
    "E2": "INCOMPLETE",
    "E3": "SUBSTANTIATED",
}
ELEMENTS = {
    "goal": {
        "G1": ("target_year",),
        "G2": ("target_metric",),
        "G3": ("baseline_year", "baseline_value"),
        "G4": ("scope", "org_boundary"),
        "G5": ("current_progress",),
        "G6": ("transition_plan",),
        "G7": ("offset_plan",),
        "G8": ("science_based_verification",),
    },
    "performance": {
        "P1": ("quantitative_or_qualified_ordinal", "unit_or_qualified_ordinal"),
        "P2": ("comparison_baseline",),
        "P3": ("method", "calculation_boundary"),
        "P4": ("assurance_covered",),
        "P5": ("absolute_intensity",),
        "P6": ("numerical_check",),
    },
    "management": {
        "M1": ("named_means_or_concrete_state",),
        "M2": ("org_boundary",),
        "M3": ("external_verification",),
        "M4": ("concrete_implementation_detail",),
        "M5": ("responsible_organization",),
        "M6": ("compensation_link",),
    },
}
TRIGGERS = {
    "G7": "offset_or_carbon_neutral_claim",
    "G8": "science_based_claim",
    "P5": "reduction_or_improvement_claim",
    "M5": "governance_claim",
    "M6": "compensation_link_claim",
}
SAFE_HARBOR = {
    "forward_looking": ("assumptions", "scenario_or_premises"),
    "emissions_estimate": ("identified_as_estimate", "estimation_method", "uncertainty"),
    "third_party_information": ("source_named", "acquisition_context", "limitations"),
}


@dataclass(frozen=True)
class Branch:
    id: str
    grade: str
    when: dict[str, bool] = field(default_factory=dict)
    cap: bool = False


def _all(id: str, grade: str, *names: str) -> Branch:
    return Branch(id, grade, {name: True for name in names})


BRANCHES = {
    "goal": (
        Branch(
            "GOAL_NO_YEAR_EXCEPTION",
            "E1",
            {"target_year": False, "target_metric": True, "transition_plan": True},
            cap=True,
        ),
        Branch("GOAL_NO_YEAR", "E0", {"target_year": False, "exception_applies": False}),
        _all(
            "GOAL_E3",
            "E3",
            "target_year",
            "target_metric",
            "baseline_year",
            "baseline_value",
            "scope",
            "org_boundary",
            "current_progress",
            "transition_plan",
        ),
        _all(
            "GOAL_E2",
            "E2",
            "target_year",
            "target_metric",
            "baseline_year",
            "baseline_value",
            "scope",
            "org_boundary",
        ),
        _all("GOAL_E1", "E1", "target_year", "target_metric"),
    ),
    "performance": (
        Branch("PERF_NO_VALUE", "E0", {"quantitative_or_qualified_ordinal": False}),
        _all(
            "PERF_E3",
            "E3",
            "quantitative_or_qualified_ordinal",
            "unit_or_qualified_ordinal",
            "comparison_baseline",
            "calculation_boundary",
            "method",
            "assurance_covered",
        ),
        _all(
            "PERF_E2",
            "E2",
            "quantitative_or_qualified_ordinal",
            "unit_or_qualified_ordinal",
            "comparison_baseline",
            "calculation_boundary",
        ),
        _all(
            "PERF_E1", "E1", "quantitative_or_qualified_ordinal", "unit_or_qualified_ordinal"
        ),
    ),
    "management": (
        _all(
            "MGMT_E3",
            "E3",
            "named_means_or_concrete_state",
            "org_boundary",
            "external_verification",
        ),
        _all("MGMT_E2", "E2", "named_means_or_concrete_state", "org_boundary"),
        _all("MGMT_E1", "E1", "named_means_or_concrete_state"),
        Branch("MGMT_WILLINGNESS", "E0", {"willingness_only": True}),
    ),
}
PRODUCT_DIRECT_FACT = "direct_product_material_ratio_or_target"
PRODUCT_CAP = "E1"
# --- end of fixed values -----------------------------------------------------------------

MAX_LADDER_FACTS = 12


def ladder_facts(track: str) -> list[str]:
    """Primitive facts the branches of a track read."""
    names = {n for b in BRANCHES[track] for n in b.when} - {"exception_applies"}
    if track == "goal":
        names |= {"target_metric", "transition_plan"}
    if len(names) > MAX_LADDER_FACTS:
        raise ValueError("unsupported ladder size")
    return sorted(names)


def required_facts() -> list[tuple[str, str]]:
    """(track, name) of every element, trigger and ladder fact."""
    out = set()
    for track, elements in ELEMENTS.items():
        for element, names in elements.items():
            out |= {(track, n) for n in names}
            if element in TRIGGERS:
                out.add((track, TRIGGERS[element]))
        out |= {(track, n) for n in ladder_facts(track)}
    return sorted(out)
