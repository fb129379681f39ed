"""Packing: no word lost, lengths chosen jointly, against all packings of few pieces."""

import numpy as np

from tidemark.llm import packing


def _all_packings(pieces):
    """Every way to deal pieces to bins."""
    if not pieces:
        yield []
        return
    for rest in _all_packings(pieces[1:]):
        yield [[pieces[0]], *rest]
        for k in range(len(rest)):
            yield [*rest[:k], [pieces[0], *rest[k]], *rest[k + 1 :]]


def _cost(sizes):
    return sum(map(packing.cost, sizes))


def test_close_to_the_cheapest_of_all_packings():
    rng, over = np.random.default_rng(8), []
    for _ in range(25):
        pieces = rng.integers(60, 3000, 7).tolist()
        best = min(_cost([min(c for c in packing.CAPACITIES if c >= sum(b)) for b in bins]) for bins in _all_packings(pieces) if max(map(sum, bins)) <= packing.CAPACITIES[-1])
        _, sizes = packing.best_fit(np.array(pieces))
        over.append(_cost(sizes) / best)
    assert np.mean(over) < 1.05 and max(over) < 1.3


def test_never_dearer_than_one_length_that_opens():
    rng = np.random.default_rng(3)
    for low, high in ((10, 300), (200, 900), (900, 1500), (1000, 5000)):
        pieces = rng.integers(low, high, 300)
        _, sizes = packing.best_fit(pieces)
        each = [_cost(packing._packed(pieces, packing.CAPACITIES, c)[1]) for c in (None, *packing.CAPACITIES)]
        assert _cost(sizes) == min(each)
    assert len({np.argmin([_cost(packing._packed(p, packing.CAPACITIES, c)[1]) for c in packing.CAPACITIES]) for p in (rng.integers(10, 200, 300), rng.integers(700, 1500, 300))}) == 2
