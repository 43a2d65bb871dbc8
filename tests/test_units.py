from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import units

ALIASES = [
    ("mm", "mm", "length", "um"), ("µm", "um", "length", "um"), ("μm", "um", "length", "um"), ("millimetres", "mm", "length", "um"), ("centimetres", "cm", "length", "um"),
    ("m", "m", "length", "um"), ("mg", "mg", "mass", "mg"), ("g", "g", "mass", "mg"), ("mg/kg", "mg/kg", "dose", "mg/kg"), ("d", "day", "time", "hour"), ("hours", "hour", "time", "hour"),
    ("%", "percent", "share", "percent"), ("per cent", "percent", "share", "percent"), ("layers", "layer", None, None), ("mL", "mL", "volume", "mL"), ("L", "L", "volume", "mL"),
]


@pytest.fixture(scope="module")
def reader():
    return units.Reader(ALIASES)


def got(reader, text):
    return sorted((u[2], float(v * Fraction(units.PER_COMMON[u[0]]) * 1000)) for v, u, _, _ in reader.read(text) if u)


@pytest.mark.parametrize("text, value", [("7,300", 7300), ("0,0964", "0.0964"), ("7 800", 7800), ("1.5 × 10^3", 1500), ("2e3", 2000), ("13,000.5", "13000.5"), ("1,234,567", 1234567), ("Eighteen", 18), ("2 × 10³", 2000), ("5e-3", "0.005")])
def test_numbers(text, value):
    assert units.value_of(text) == Fraction(str(value))


@pytest.mark.parametrize(
    "text, want",
    [
        ("It is 0.4 mm thick.", [("um", 400_000)]), ("5–10 µm and 28mg/kg", [("mg/kg", 28_000), ("um", 5_000), ("um", 10_000)]),
        ("between 3 and 4 mL", [("mL", 3_000), ("mL", 4_000)]), ("a 0.75-mg/kg dose", [("mg/kg", 750)]), ("About 6 layers of cells", []), ("for 1.5 d before", [("hour", 36_000)]),
        ("CD34 m, in 1987, 10² fields, Figure 3 of", []), ("three hours", [("hour", 3_000)]), ("ｆｏｒ ２ mm", [("um", 2_000_000)]), ("5​ m​m", [("um", 5_000_000)]),
        ("33 % or 7 per cent", [("percent", 7_000), ("percent", 33_000)]), ("5 m²", []), ("at least 1 000 mg", [("mg", 1_000_000)]), ("", []),
        ("| A | Width (mm) |\n| --- | --- |\n| x | 2 |\n| y | 0.5 |", [("um", 500_000), ("um", 2_000_000)]),
        ("| A | Weight in mg |\n| --- | --- |\n| x | 3–4 |", [("mg", 3_000), ("mg", 4_000)]),
        ("Values below are in centimetres.\n- a: 0.5\n- b: 2\n\nThe 7 others", [("um", 5_000_000), ("um", 20_000_000)]),
    ],
)
def test_reading(reader, text, want):
    assert got(reader, text) == sorted(want)


def test_conflicting_alias():
    with pytest.raises(ValueError):
        units.Reader([("x", "mm", "length", "um"), ("x", "mg", "mass", "mg")])


def test_found_whole_and_nulls(spark):
    p = spark.createDataFrame([("a", "s", "2 mm wide", 1), ("a", "s", "2 mm wide", 1), (None, "s", "2 mm", 1), ("b", None, None, None), ("c", "s", "", 0)], "passage_id string, source_id string, text string, value int")
    u = spark.createDataFrame(ALIASES, "alias string, unit string, dimension string, common_unit string")
    assert [tuple(r) for r in units.found(p, u).collect()] == [("a", "um", 2_000_000)]
    assert units.found(p.limit(0), u).count() == 0
    assert units.infer_units(p.limit(0), u).count() == 0


def test_mixture_recovers_units():
    r = np.random.default_rng(0)
    edges = np.linspace(-8, 12, 201)
    hist = lambda v: np.histogram(np.log10(v), edges)[0].astype(float)
    base = 10 ** r.normal(1, 0.3, 4000)  # micrometres
    explicit = {"um": hist(base[:1500]), "cm": hist(base[1500:2000] / 10_000)}
    bare = np.concatenate([base[2000:3000], base[3000:3500] / 10_000])
    post = units.fit_mixture(explicit, hist(bare), {"um": 0.0, "cm": 4.0})
    k = np.clip(((np.log10(bare) + 8) / units.BIN).astype(int), 0, 199)
    guess = np.where(post["um"][k] > 0.5, "um", "cm")
    assert (guess[:1000] == "um").mean() > 0.98 and (guess[1000:] == "cm").mean() > 0.98


def test_inference_flags(spark):
    rows = [(f"a{i}", "s", f"The layer measures {10 + i % 7} µm here.") for i in range(40)] + [("b", "s", "The layer measures 12 here."), ("c", "s", "No number")]
    p = spark.createDataFrame(rows, "passage_id string, source_id string, text string")
    u = spark.createDataFrame(ALIASES, "alias string, unit string, dimension string, common_unit string")
    r = units.infer_units(p, u).where(F.col("passage_id") == "b").collect()
    assert len(r) == 1 and r[0].unit == "um" and r[0].value_milli == 12_000 and not r[0].uncertain
