import numpy as np

from docsift.llm.packing import best_two_fit


def test_copies_of_one_length_give_way_to_two_that_fill_the_gap():
    counts = np.zeros(11, np.int64)
    counts[4], counts[3] = 2, 2
    out = best_two_fit(counts)
    assert out[0] == (1, {4: 1, 3: 2})
    assert sum(t * u.get(n, 0) * n for t, u in out for n in (3, 4)) == 14
