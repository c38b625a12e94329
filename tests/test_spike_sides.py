import numpy as np

from almagest.operators.spikes import spike_profile


def test_neighbours_on_opposite_sides_of_the_level():
    rng = np.random.default_rng(8)
    x = np.log(10.0) + np.cumsum(rng.normal(0, 0.01, 300))
    for at, off in ((60, [4.6, -4.6]), (150, [-3.0, 3.0, -3.0]), (240, [2.5, 2.5])):
        x[at : at + len(off)] += off
    assert np.flatnonzero(spike_profile(x)[2]).tolist() == [60, 61, 150, 151, 152, 240, 241]
