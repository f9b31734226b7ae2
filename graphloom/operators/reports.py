"""Report scores: risk, friction, debt, tests, coverage, pull requests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions.numeric import half_up, half_up_to, steps, tiers
from graphloom.functions.text import any_of

#: Fixed values of the risk score: steps of each factor, then the weights.
COMPLEXITY_RISK = [(5, 0.1), (10, 0.3), (20, 0.5), (30, 0.7)]
CALLER_RISK = [(2, 0.1), (5, 0.3), (10, 0.5), (20, 0.7)]
CHURN_RISK = [(1, 0.1), (3, 0.3), (5, 0.5), (10, 0.7)]
CONFIDENCE_RISK = [(0.9, 0.1), (0.7, 0.3), (0.5, 0.5)]
RISK_WEIGHTS = {"business": 0.30, "complexity": 0.25, "callers": 0.20, "churn": 0.15, "confidence": 0.10}


def risk_score(domain: Column, complexity: Column, callers: Column, churn: Column, confidence: Column) -> Column:
    """0 to 92, from five factors; unknown complexity counts as 0.3, unknown confidence as 0.5."""
    w = RISK_WEIGHTS
    unknown = complexity.isNull() | (complexity == 0)
    return half_up(
        100
        * (
            F.when(domain, 0.8).otherwise(0.3) * w["business"]
            + F.when(unknown, 0.3).otherwise(steps(complexity, COMPLEXITY_RISK, 1.0)) * w["complexity"]
            + steps(F.coalesce(callers, F.lit(0)), CALLER_RISK, 1.0) * w["callers"]
            + steps(churn, CHURN_RISK, 1.0) * w["churn"]
            + F.when(confidence.isNull(), 0.5).otherwise(tiers(confidence, CONFIDENCE_RISK, 0.8)) * w["confidence"]
        )
    )


def risk_level(score: Column) -> Column:
    return tiers(score, [(70, "HIGH"), (40, "MEDIUM")], "LOW")


def bus_risk(factor: Column) -> Column:
    return steps(factor, [(1, "CRITICAL"), (2, "MODERATE")], "HEALTHY")


def friction(complexity: Column, churn: Column, weight: Column) -> Column:
    return complexity * F.greatest(F.lit(1.0), churn) * weight


# The steps and points of the score below.
def effort(complexity: Column, callers: Column) -> Column:
    """Story points."""
    base = F.when(complexity > 30, 5).when(complexity > 20, 3).when(complexity > 10, 2).otherwise(1)
    return base + F.when(callers > 20, 2).when(callers > 10, 1).otherwise(0)


def monthly_hours(friction_: Column, churn: Column) -> Column:
    return 0.5 * F.log2(friction_ + 1) / 3 * churn


def return_on_effort(points: Column, hours: Column, months: int = 6) -> Column:
    """Hours saved over the months for each hour of the points, four hours a point."""
    return F.when(points == 0, F.lit(0.0)).otherwise(half_up_to(hours * months / (points * 4), 1))


# The steps and points of the score below.
def debt_score(complexity: Column, churn: Column, weight: Column, callers: Column) -> Column:
    part = lambda x, most: F.least(x / F.lit(float(most)), F.lit(1.0))
    return half_up(part(complexity, 30) * 40 + part(churn, 10) * 30 + part(callers, 20) * weight * 30)


# The steps and points of the score below.
def god_class(complexity: Column, methods: Column) -> Column:
    score = complexity / 30.0 + methods / 15.0
    return F.when(score > 2, "CRITICAL").when(score > 1.3, "HIGH").otherwise("MEDIUM")


# The steps and points of the score below.
def change_frequency(changes: Column, days: int = 30) -> Column:
    weekly = changes * 7.0 / days
    return tiers(weekly, [(7, "Daily or more"), (3, "Several times per week"), (1, "Weekly"), (0.5, "Bi-weekly")], "Monthly or less")


# The steps and points of the score below.
def test_quality(strong: Column, mocks: Column, match: Column, errors: Column, snapshot_only: Column) -> Column:
    """100 less what weak assertions, mocks, a mismatch, missing error cases and bare snapshots cost."""
    lost = (
        F.when(strong < 0.3, 30).when(strong < 0.5, 15).when(strong < 0.7, 5).otherwise(0)
        + F.when(mocks > 0.8, 25).when(mocks > 0.5, 10).otherwise(0)
        + F.when(match < 0.2, 20).when(match < 0.5, 10).otherwise(0)
        + F.when(errors, 0).otherwise(10)
        + F.when(snapshot_only, 15).otherwise(0)
    )
    return F.greatest(F.lit(0), F.least(F.lit(100), 100 - lost))


def test_verdict(score: Column) -> Column:
    return tiers(score, [(70, "VALID"), (40, "SUSPICIOUS")], "COVERAGE_PADDING")


# The steps and points of the score below.
def criticality(domain: Column, infrastructure: Column, area: Column, confidence: Column, purpose: Column, incidents: Column) -> Column:
    """Business criticality, 0 to 100."""
    low, why = F.lower(area), F.lower(F.coalesce(purpose, F.lit("")))
    of_area = F.when(any_of(low, ["payment", "billing", "revenue", "checkout", "transaction"]), 20).when(any_of(low, ["user", "auth", "profile"]), 10).otherwise(0)
    score = (
        50
        + F.when(domain, 25 + of_area).when(infrastructure, -15).otherwise(0)
        + F.when(confidence > 0.8, 8).otherwise(0)
        + F.when(any_of(why, ["revenue", "payment", "critical", "transaction"]), 12).otherwise(0)
        + F.least(F.lit(15), incidents * 5)
    )
    return F.least(F.lit(100), F.greatest(F.lit(0), score))


# The steps and points of the score below.
def layer(domain: Column, infrastructure: Column, area: Column) -> Column:
    low = F.lower(area)
    return (
        F.when(domain & any_of(low, ["payment", "billing", "checkout", "order", "subscription", "revenue"]), "revenue-critical")
        .when(domain & any_of(low, ["user", "dashboard", "settings", "profile", "notification"]), "user-facing")
        .when(domain, "internal")
        .when(infrastructure, "infrastructure")
        .otherwise("unknown")
    )


#: Coverage targets in percent, and the weight of a layer in the total.
TARGETS = {"revenue-critical": 95, "user-facing": 80, "internal": 70, "infrastructure": 50, "unknown": 50}
LAYER_WEIGHTS = {"revenue-critical": 4.0, "user-facing": 2.0, "internal": 1.0, "infrastructure": 0.5, "unknown": 0.5}


def coverage_status(percentage: Column, target: Column) -> Column:
    return F.when(percentage >= target, "healthy").when(percentage >= target - 15, "warning").otherwise("critical")


def likely_tested(name: Column, path: Column, complexity: Column, callers: Column) -> Column:
    """By conventions; where none applies, six of ten by a hash of the name, the same on every run."""
    low = F.lower(path)
    return (
        low.contains("test")
        | low.contains("spec")
        | (complexity <= 3)
        | (low.contains("services/") & (callers > 3))
        | ((complexity < 10) & (callers > 2))
        | (F.crc32(name.cast("binary")) % 10 < 6)
    )


# The steps and points of the score below.
def pull_request_factors(domain_share: Column, callers: Column, incidents: Column, author_changes: Column, complexity: Column) -> Column:
    """30 and the five contributions."""
    return (
        30
        + F.when(domain_share > 80, 20).when(domain_share > 50, 12).otherwise(5)
        + F.when(callers > 30, 15).when(callers > 10, 8).otherwise(3)
        + F.when(incidents > 2, 15).when(incidents > 0, 8).otherwise(0)
        + F.when(author_changes < 3, 10).when(author_changes < 10, 5).otherwise(-5)
        + F.when(complexity > 20, 10).when(complexity > 10, 5).otherwise(0)
    )


def pull_request_score(base: Column, business: Column, radius: Column) -> Column:
    return F.least(F.lit(100), half_up(base * F.sqrt(business * radius)))


def modification_friction(complexity: Column, changes: Column, mean: Column) -> Column:
    return half_up_to(F.greatest(F.lit(1.0), complexity / mean) * F.greatest(F.lit(1.0), changes / 5.0), 1)


def status(score: Column) -> Column:
    return tiers(score, [(70, "GOOD"), (40, "WARNING")], "CRITICAL")


def side_effect_risk(effects: Column, unconditional: Column, severe: Column) -> Column:
    return F.when(effects == 0, "none").when(severe > 0, "high").when(unconditional > 0, "medium").otherwise("low")
