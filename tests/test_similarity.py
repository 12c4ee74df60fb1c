import pytest

from kinweave.functions.similarity import jaro, jaro_winkler


@pytest.mark.parametrize("a,b,want", [("MARTHA", "MARHTA", 0.961111), ("DWAYNE", "DUANE", 0.84), ("DIXON", "DICKSONX", 0.813333)])
def test_published_values(a, b, want):
    assert round(jaro_winkler(a, b), 6) == want


def test_edges():
    assert jaro("", "") == jaro_winkler("", "") == 1.0
    assert jaro("a", "") == jaro("abc", "xyz") == 0.0
    assert jaro_winkler("ab", "ab", 0.25, 4) == 1.0
    with pytest.raises(ValueError):
        jaro_winkler("a", "b", 0.3, 4)
