"""The capitals feature has one definition at every length."""

from sieveline.llm.toxicity import FEATURES, FeatureMaker


def test_capitals_do_not_depend_on_length():
    at = (FEATURES.split() if isinstance(FEATURES, str) else list(FEATURES)).index("capitals")
    make = FeatureMaker({})
    for unit in ("ABc déF ", "ЖУк ΑΩα ŒuŠĐ ", "𝐀𐐀ǅ Ⓐ "):
        want = sum(c.isupper() for c in unit) / len(unit)
        assert [abs(make(unit * n)[at] - want) < 1e-12 for n in (3, 1000)] == [True, True]
