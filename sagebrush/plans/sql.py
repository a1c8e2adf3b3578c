"""SQL fragments that the oracle queries share."""

from __future__ import annotations


def p_value(r: str, n: str, covariates: int = 0) -> str:
    """Two-sided p of a correlation, by the same finite series in closed form."""
    v = f"(({n}) - {2 + covariates})"
    even = f"1 - abs({r}) * coalesce(list_sum(list_transform(range(1, CAST({v} / 2 AS BIGINT) + 1), lambda j: exp(lgamma(j - 0.5) - lgamma(0.5) - lgamma(j)) * pow(1 - ({r}) * ({r}), j - 1))), 0)"
    odd = f"1 - (2 / pi()) * (asin(abs({r})) + abs({r}) * coalesce(list_sum(list_transform(range(1, CAST(({v} - 1) / 2 AS BIGINT) + 1), lambda j: exp(lgamma(j) + lgamma(1.5) - lgamma(j + 0.5)) * pow(1 - ({r}) * ({r}), j - 0.5))), 0))"
    return f"CASE WHEN {v} >= 1 AND abs({r}) < 1 THEN greatest(0, least(1, CASE WHEN {v} % 2 = 0 THEN {even} ELSE {odd} END)) END"


def corr(a: str, b: str) -> str:
    """NULL without variance."""
    return f"CASE WHEN count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) >= 2 AND NOT isnan(corr({a}, {b})) THEN greatest(-1, least(1, corr({a}, {b}))) END"


def partial(xy: str, xz: str, yz: str) -> str:
    return f"CASE WHEN (1 - {xz} * {xz}) * (1 - {yz} * {yz}) > 0 THEN greatest(-1, least(1, ({xy} - {xz} * {yz}) / sqrt((1 - {xz} * {xz}) * (1 - {yz} * {yz})))) END"


def average_rank(keys: str, value: str) -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    same = f"PARTITION BY {keys}, {value}" if keys else f"PARTITION BY {value}"
    return f"rank() OVER ({part}ORDER BY {value}) + (count(*) OVER ({same}) - 1) / 2.0"
