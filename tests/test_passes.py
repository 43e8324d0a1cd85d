import pytest

from weftline.operators.passes import Passes, TooLong, in_halves


def test_calls_in_halves():
    def call(units):
        if len(units) > 3 or "bad" in units:
            raise TooLong
        return [u.upper() for u in units]

    done, lost = in_halves(list("abcdefgh"), call)
    assert (done, lost) == (list("ABCDEFGH"), [])
    done, lost = in_halves(["a", "bad", "c", "d"], call)
    assert (done, lost) == (["A", "C", "D"], ["bad"])
    assert in_halves([], call) == ([], []) and in_halves(["a"] * 100, call, 2) == ([], ["a"] * 100)
    with pytest.raises(KeyError):
        in_halves(["a"], lambda units: {}[units[0]])


def test_a_pass_is_added_once():
    passes = Passes()
    passes.add("a", ["py"], lambda e: e)
    with pytest.raises(ValueError):
        passes.add("a", ["go"], lambda e: e)
