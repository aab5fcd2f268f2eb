import numpy as np
import pytest

from leafwright.llm.boost import Boosted


def test_learns_an_interaction_and_agrees_row_by_row():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = Boosted().fit(x[:400], y[:400])
    p = model.probability(x[400:])
    assert ((p > 0.5) == y[400:]).mean() > 0.9
    assert [model.probability_of(list(r)) for r in x[400:420]] == pytest.approx(list(p[:20]))


@pytest.mark.parametrize("y", [[], [1, 1, 1], [0, 0]])
def test_one_class_or_nothing(y):
    model = Boosted().fit(np.zeros((len(y), 2)), np.array(y, float))
    assert (model.probability(np.zeros((1, 2)))[0] > 0.5) == bool(y and y[0])
