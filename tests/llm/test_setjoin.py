import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import got
from tracelake.llm import setjoin as S


def brute(sets, threshold):
    names = sorted(sets)
    out = []
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common >= threshold * (len(sets[a]) + len(sets[b]) - common) - 1e-9:
                out.append((a, b))
    return sorted(out)


def random_sets(seed, n, hot=True):
    rng = random.Random(seed)
    sets = {}
    for i in range(n):
        if sets and rng.random() < 0.5:
            base = set(rng.choice(list(sets.values())))
            for _ in range(rng.randrange(4)):
                base.symmetric_difference_update({f"t{rng.randrange(300)}"})
        else:
            base = {f"t{int(rng.random() ** 3 * 300)}" for _ in range(rng.randrange(1, 30))}
        if hot and rng.random() < 0.9:
            base.add("hot")
        sets[f"r{i:03}"] = base
    return sets


@pytest.mark.parametrize("threshold, least", [(0.6, 4), (0.8, 1), (0.5, 2)])
def test_against_brute_force(rows, threshold, least):
    sets = random_sets(int(threshold * 10), 160)
    data = [(r, "x", t, "clash") for r, s in sets.items() for t in s]
    data += data[:40] + [(None, "x", "t1", ""), ("r000", None, None, "")]
    sets["r000"].add(None)
    df = rows(data, "rep string, term_type string, item string, rep_a string")
    pairs, members = S.similar_records(S.record_sets(df, "rep", ["term_type", "item"], least), threshold)
    assert got(S.expand_pairs(pairs, members)) == brute({r: s for r, s in sets.items() if len(s) >= least}, threshold)


def test_equal_sets_are_one_class(rows):
    data = [(f"c{i}", f"t{j}") for i in range(60) for j in range(5)] + [("other", f"t{j}") for j in range(1, 5)]
    pairs, members = S.similar_records(S.record_sets(rows(data, "r string, t string"), "r", ["t"], 1), 0.8)
    assert got(pairs) == [("c0", "other")]
    assert members.where("rep = 'c0'").count() == 60
    assert S.expand_pairs(pairs, members).count() == 60 * 59 // 2 + 60


def test_no_rows(rows):
    pairs, members = S.similar_records(S.record_sets(rows([], "r string, t string"), "r", ["t"], 1), 0.6)
    assert got(pairs) == [] and got(members) == []


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 60), st.integers(0, 10_000), st.sampled_from([0.5, 0.6, 0.8, 0.95]))
def test_keys_meet_whatever_the_shares(size, seed, threshold):
    """Any two sets within the threshold share a key, for any token frequencies."""
    rng = random.Random(seed)
    bands = S.Bands(threshold)
    long = sorted({rng.getrandbits(62) - (1 << 61) for _ in range(size)})
    share = {t: rng.choice([1e-5, 1e-3, 0.05, 0.9]) for t in long}
    short = list(long)
    while True:
        keep = rng.sample(short, len(short) - 1) if rng.random() < 0.6 and len(short) > 1 else [*rng.sample(short, len(short) - 1), rng.randrange(1 << 60)]
        for t in keep:
            share.setdefault(t, rng.choice([1e-5, 0.05]))
        common = len(set(keep) & set(long))
        if common < threshold * (len(keep) + len(long) - common) - 1e-9:
            break
        short = keep
        if rng.random() < 0.2:
            break
    a, b = sorted((sorted(short), long), key=len)
    hot = lambda tokens: [share[t] > S.FREQUENT for t in tokens]
    unsigned = lambda tokens: [t % (1 << 64) for t in tokens]
    assert S.probe_keys(unsigned(a), [share[t] for t in a], hot(a), bands) & S.index_keys(unsigned(b), hot(b), bands)
    # sketches differ in no more bits than the sets do in tokens
    assert ((S.sketch(unsigned(a)) ^ S.sketch(unsigned(b))) % (1 << 64)).bit_count() <= len(set(a) ^ set(b))


def test_bands_cover_all_lengths():
    bands = S.Bands(0.6)
    for n in range(1, 3000):
        low, high, count = bands.lengths(S.band_of(n))
        assert low <= n <= high and count > 1
        worst = max(S.most_different(n, s, 0.6) for s in range(max(1, -(-n * 6 // 10)), n + 1))
        assert 2 * count > worst
