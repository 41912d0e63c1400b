from fractions import Fraction

import numpy as np
import pytest

from pointweave.llm import mixing


def test_shares_are_met_exactly_over_many_slots():
    r = np.random.default_rng(3)
    rows = {str(i): int(n) for i, n in enumerate([10_000_000, *r.integers(100_000, 2_000_000, 19)])}
    shares, blocks = {s: n**0.5 for s, n in rows.items()}, {s: -(-n // 64) for s, n in rows.items()}
    plan = mixing.schedule(blocks, shares)
    places = {s: plan.slots(s, np.arange(n)) for s, n in blocks.items()}
    end = min(int(p[-1]) for p in places.values()) + 1  # the first source has run out
    assert end > 50_000 and np.array_equal(np.sort(np.concatenate(list(places.values()))), np.arange(sum(blocks.values())))
    whole = sum(map(Fraction, shares.values()))
    for s, p in places.items():
        ran, due = 0, Fraction(shares[s]) / whole
        for at in p[p < end].tolist():
            assert -1 < ran - due * at < 1 and -1 < ran + 1 - due * (at + 1) < 1
            ran += 1
        assert -1 < ran - due * end < 1


def test_small_and_zero_shares():
    blocks = {"a": 3000, "b": 2, "c": 5, "d": 5}
    plan = mixing.schedule(blocks, {"a": 1.0, "b": 0.0005, "c": 0, "d": 0.0})
    b = plan.slots("b", np.arange(2))
    assert 0 <= b[0] <= 2001 and 2001 <= b[1] <= 4002
    assert sorted([*plan.slots("c", np.arange(5)), *plan.slots("d", np.arange(5))]) == list(range(3002, 3012))
    with pytest.raises(ValueError, match="shares"):
        mixing.schedule({"a": 1}, {"a": -1.0})
