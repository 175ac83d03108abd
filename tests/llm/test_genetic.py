"""The genetic algorithm where best fit is not enough: triplets that fill a sequence exactly."""

import random

import pytest

from tidemark.llm.packing import Island


def triplets(seed, n, capacity=2048):
    rng, out = random.Random(seed), []
    for _ in range(n):
        a = rng.randint(780, 970)
        b = rng.randint(512, (capacity - a) // 2)
        out += [a, b, capacity - a - b]
    rng.shuffle(out)
    return out


def sound(island, bins):
    assert sorted(i for b in bins for i in b) == list(range(len(island.sizes)))
    assert all(island.fill(b) <= island.capacity for b in bins)
    return len(bins)


@pytest.mark.parametrize("seed", range(4))
def test_evolution_beats_best_fit(seed):
    island = Island(triplets(seed, 20), 2048, seed)
    plain = sound(island, island.best_fit([], list(range(60))))
    assert sound(island, island.evolve(None, [])) < plain and plain >= 23


def test_each_step_keeps_every_piece_once():
    island = Island(triplets(9, 30), 2048, 1)
    a = island.best_fit([], list(range(90)))
    b = island.mutate(a)
    sound(island, b)
    sound(island, island.cross(a, b))
    full = [x for x in b if island.fill(x) >= 2040][:5]
    child = island.injected(a, full)
    sound(island, child)
    assert len(child) <= len(a) + len(full)
    loose = [i for x in a[:6] for i in x]
    rest = [list(x) for x in a[6:]]
    filled = sum(map(island.fill, rest))
    left = island.exchange(rest, loose)
    assert sorted([i for x in rest for i in x] + left) == list(range(90)) and sum(map(island.fill, rest)) >= filled


def test_elites_of_another_island_help():
    sizes = triplets(3, 40)
    island = Island(sizes, 2048, 5)
    first = island.best_fit([], list(range(120)))
    best = Island(sizes, 2048, 6).evolve(None, [])
    patterns = [sorted((sizes[i] for i in b), reverse=True) for b in best if sum(sizes[i] for i in b) >= 2047]
    taken = island.patterns(patterns)
    assert len(taken) == len(patterns) and len(sound_bins := island.injected(first, taken)) < len(first)
    sound(island, sound_bins)
