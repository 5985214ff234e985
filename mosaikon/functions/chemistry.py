"""Masses and formulas as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Monoisotopic masses in Da, and the electron.
ELEMENTS = {
    "H": 1.0078250319, "C": 12.0, "N": 14.0030740052, "O": 15.9949146221, "P": 30.97376151, "S": 31.97207069, "Na": 22.98976928, "K": 38.96370649, "Cl": 34.96885268,
}
ELECTRON = 0.00054857990907
C13_STEP = 1.0033548

_M = ELEMENTS
# Adducts by polarity, the shift of the neutral mass, and the charge.
ADDUCTS = {
    "negative": {
        "[M-H]-": (-_M["H"] + ELECTRON, 1), "[M+Cl]-": (_M["Cl"] + ELECTRON, 1), "[M+HCOO]-": (_M["H"] + _M["C"] + 2 * _M["O"] + ELECTRON, 1),
        "[M-CH3]-": (-(_M["C"] + 3 * _M["H"]) + ELECTRON, 1), "[M-2H]2-": (2 * (-_M["H"] + ELECTRON), 2), "[M-3H]3-": (3 * (-_M["H"] + ELECTRON), 3), "[M+CH3COO]-": (2 * _M["C"] + 3 * _M["H"] + 2 * _M["O"] + ELECTRON, 1),
    },
    "positive": {
        "[M+H]+": (_M["H"] - ELECTRON, 1), "[M+Na]+": (_M["Na"] - ELECTRON, 1), "[M+K]+": (_M["K"] - ELECTRON, 1), "[M+NH4]+": (_M["N"] + 4 * _M["H"] - ELECTRON, 1),
        "[M+2H]2+": (2 * (_M["H"] - ELECTRON), 2),
    },
}

# Abundant species without near isobars that calibration is measured against, by polarity.
CALIBRATION_ANCHORS = {
    "negative": ("[M-H]-", ["FA 18:1", "FA 22:6", "FA 24:1", "PE 38:4", "PS 40:6", "PI 38:4", "Sulfatide 42:1;O2", "Sulfatide 42:2;O2"]),
    "positive": ("[M+H]+", ["PC 32:0", "PC 34:1", "SM 34:1", "PE 38:4"]),
}

# Stable isotopes as (mass in Da, abundance), the lightest first.
ISOTOPES = {
    "H": [(1.0078250319, 0.999885), (2.0141017779, 0.000115)],
    "C": [(12.0, 0.9893), (13.0033548378, 0.0107)],
    "N": [(14.0030740052, 0.996205), (15.0001088989, 0.003795)],
    "O": [(15.9949146221, 0.99757), (16.99913170, 0.00038), (17.99915961, 0.00205)],
    "P": [(30.97376151, 1.0)],
    "S": [(31.97207069, 0.9499), (32.97145850, 0.0075), (33.96786683, 0.0425), (35.96708088, 0.0001)],
    "Na": [(22.98976928, 1.0)],
    "K": [(38.96370649, 0.932581), (39.96399817, 0.000117), (40.96182526, 0.067302)],
    "Cl": [(34.96885268, 0.7576), (36.96590258, 0.2424)],
}
# The atoms that an adduct adds to the neutral formula.
ADDUCT_ATOMS = {
    "[M-H]-": {"H": -1}, "[M-2H]2-": {"H": -2}, "[M-3H]3-": {"H": -3}, "[M-CH3]-": {"C": -1, "H": -3}, "[M+Cl]-": {"Cl": 1},
    "[M+HCOO]-": {"C": 1, "H": 1, "O": 2}, "[M+CH3COO]-": {"C": 2, "H": 3, "O": 2},
    "[M+H]+": {"H": 1}, "[M+2H]2+": {"H": 2}, "[M+NH4]+": {"N": 1, "H": 4}, "[M+Na]+": {"Na": 1}, "[M+K]+": {"K": 1},
}


def isotope_logs(element: str, offsets: int) -> list[tuple[float, float]]:
    """(l, dl) for 1..offsets nucleons: the logarithm of an atom's isotopes as a power series, and its mass moment.

    The series is 1 + r1 x + r2 x^2 + ..., r being abundances over the lightest one's; dl is the derivative of l when
    each r grows by the factor e^(t * extra mass).  A formula's envelope needs their sums over atoms only.
    """
    (m0, a0), *others = ISOTOPES[element]
    r, dr = [1.0] + [0.0] * offsets, [0.0] * (offsets + 1)
    for m, a in others:
        if round(m - m0) <= offsets:
            r[round(m - m0)], dr[round(m - m0)] = a / a0, a / a0 * (m - m0)
    l, dl = [0.0] * (offsets + 1), [0.0] * (offsets + 1)
    for k in range(1, offsets + 1):
        l[k] = r[k] - sum(j * l[j] * r[k - j] for j in range(1, k)) / k
        dl[k] = dr[k] - sum(j * (dl[j] * r[k - j] + l[j] * dr[k - j]) for j in range(1, k)) / k
    return list(zip(l[1:], dl[1:], strict=True))


def parse_formula(formula: Column) -> Column:
    """A Hill formula as map<element, count>; repeated elements add up."""
    names = F.regexp_extract_all(formula, F.lit(r"([A-Z][a-z]?)(\d*)"), 1)
    counts = F.regexp_extract_all(formula, F.lit(r"([A-Z][a-z]?)(\d*)"), 2)
    pairs = F.transform(F.arrays_zip(names.alias("e"), counts.alias("n")), lambda p: F.struct(p["e"].alias("e"), F.when(p["n"] == "", 1).otherwise(p["n"].cast("int")).alias("n")))
    total = lambda e: F.aggregate(F.filter(pairs, lambda p: p["e"] == e), F.lit(0), lambda a, p: a + p["n"])
    return F.map_from_entries(F.transform(F.array_distinct(names), lambda e: F.struct(e, total(e))))


def formula_mass(counts: Column) -> Column:
    """The monoisotopic mass of map<element, count>; null if an element isn't known."""
    masses = F.create_map(*[x for e, m in ELEMENTS.items() for x in (F.lit(e), F.lit(m))])
    return F.aggregate(F.map_entries(counts), F.lit(0.0), lambda a, e: a + F.try_element_at(masses, e["key"]) * e["value"])


def ion_mz(neutral: Column, adduct: str) -> Column:
    shift, z = next(a[adduct] for a in ADDUCTS.values() if adduct in a)
    return (neutral + F.lit(shift)) / F.lit(z)


def ppm_error(observed: Column, theory: Column) -> Column:
    """Signed error in parts per million; null where theory is zero."""
    return F.when(theory != 0, (observed - theory) / theory * 1e6)
