"""SQL text of the probability tails, as power series, for the oracle statements."""


def _beta(a: str, b: str, x: str, terms: int = 400) -> str:
    """Regularised incomplete beta I_x(a, b), for x below the mean."""
    return f"""(CASE WHEN {x} <= 0 THEN 0 ELSE exp(({a}) * ln({x}) + ({b}) * ln(1 - ({x})) - ln({a}) - lgamma({a}) - lgamma({b}) + lgamma(({a}) + ({b})))
  * list_sum(list_transform(range({terms}), lambda i: exp(lgamma(({a}) + ({b}) + i) - lgamma(({a}) + ({b})) + lgamma(({a}) + 1) - lgamma(({a}) + 1 + i) + i * ln({x})))) END)"""


def t_two_sided(t: str, dof: str) -> str:
    return f"(1 - {_beta('0.5', f'({dof}) / 2.0', f'(({t}) * ({t}) / (({dof}) + ({t}) * ({t})))')})"


def t_sf(t: str, dof: str) -> str:
    return f"(CASE WHEN {t} >= 0 THEN {t_two_sided(t, dof)} / 2 ELSE 1 - {t_two_sided(t, dof)} / 2 END)"


def f_sf(f: str, d1: str, d2: str) -> str:
    x = f"(({d1}) * ({f}) / (({d1}) * ({f}) + ({d2})))"
    return f"(1 - {_beta(f'({d1}) / 2.0', f'({d2}) / 2.0', x)})"


def chi2_sf(x: str, dof: str, terms: int = 400) -> str:
    a, h = f"(({dof}) / 2.0)", f"(({x}) / 2.0)"
    return f"""(1 - (CASE WHEN {x} <= 0 THEN 0 ELSE list_sum(list_transform(range({terms}),
  lambda i: exp(({a} + i) * ln({h}) - {h} - lgamma({a} + i + 1)))) END))"""


def normal_sf(z: str) -> str:
    """0.5 erfc(z / sqrt 2) from the chi-square form of z^2."""
    tail = chi2_sf(f"(({z}) * ({z}))", "1")
    return f"(CASE WHEN {z} >= 0 THEN 0.5 * {tail} ELSE 1 - 0.5 * {tail} END)"
