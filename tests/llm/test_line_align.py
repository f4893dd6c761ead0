import random

from tessera.llm import line_align


def brute(a, b, alone):
    useful = {(p, q) for p in range(len(a)) for q in range(len(b)) if a[p] == b[q] and (p in alone or any(0 <= p + s < len(a) and 0 <= q + s < len(b) and a[p + s] == b[q + s] for s in (-1, 1)))}
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for p in range(len(a)):
        for q in range(len(b)):
            best[p + 1][q + 1] = max(best[p][q + 1], best[p + 1][q], best[p][q] + ((p, q) in useful))
    return best[-1][-1]


def fitting(a, b, alone):
    return {(p, q) for p in range(len(a)) for q in range(len(b)) if a[p] == b[q] and (p in alone or any(0 <= p + s < len(a) and 0 <= q + s < len(b) and a[p + s] == b[q + s] for s in (-1, 1)))}


def sound(a, b, got):
    places = [got[p] for p in sorted(got)]
    return all(a[p] == b[q] for p, q in got.items()) and all(x < y for x, y in zip(places, places[1:]))


def test_gaps_without_unique_lines_are_aligned_in_full():
    rng = random.Random(4)
    for _ in range(600):
        letters = rng.choice((2, 4, 12))
        a, b = ([rng.randrange(letters) for _ in range(rng.randrange(14))] for _ in range(2))
        alone = {p for p in range(len(a)) if rng.random() < 0.3}
        m = line_align.Matches(a, b, alone)
        full = line_align.aligned_in_full(m, 0, len(a), 0, len(b))
        assert sound(a, b, dict(full)) and set(full) <= fitting(a, b, alone) and len(full) == brute(a, b, alone)


def test_alignment_by_patience():
    """Sound, never longer than a longest one, at least as long as the anchors in order, and seldom shorter than a longest one."""
    rng = random.Random(6)
    shorter = 0
    for _ in range(1500):
        letters = rng.choice((2, 4, 12, 40))
        a, b = ([rng.randrange(letters) for _ in range(rng.randrange(14))] for _ in range(2))
        alone = {p for p in range(len(a)) if rng.random() < 0.3}
        got, most = line_align.align(a, b, alone), brute(a, b, alone)
        once = [p for p in range(len(a)) if a.count(a[p]) == b.count(a[p]) == 1]
        unique = [b.index(a[p]) for p in once if (p, b.index(a[p])) in fitting(a, b, alone)]
        assert sound(a, b, got) and len(line_align.longest_increasing(unique)) <= len(got) <= most
        shorter += len(got) < most
    assert shorter < 150


def test_repeated_lines_align_and_blocks_stay_whole():
    a = [1, 2, 1, 2, 3, 3, 3]
    assert line_align.align(a, a, set()) == {i: i for i in range(7)}
    assert line_align.align([1, 2], [1, 9, 1, 2], set()) == {0: 2, 1: 3}


def test_long_alternating_lines_shifted_by_one():
    for n in (1201, 2201, 6001):
        a = [i % 2 for i in range(n)]
        assert len(line_align.align(a, a[1:], set())) == n - 1 == len(line_align.align(a[1:], a, set()))


def test_long_documents_of_few_lines_and_of_unique_ones():
    rng = random.Random(7)
    a, b = ([rng.randrange(5) for _ in range(4000)] for _ in range(2))
    assert len(line_align.align(a, b, set())) > 2000
    own = list(range(30_000))
    moved = own[15_000:] + own[:15_000]
    assert len(line_align.align(own, moved, set())) == 15_000
