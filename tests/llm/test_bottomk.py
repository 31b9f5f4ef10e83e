"""Bottom-k near-duplicates against brute force over all pairs, with sketches smaller than the sets and split lists."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from conftest import lines

from parchment.llm import bottomk


def shingles(t, width=3):
    w = brute.WORD.findall(brute.lower(t or ""))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def plain(data, percent=85, width=3):
    sets = [shingles(t, width) for _, t in data]
    root = list(range(len(data)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(data):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    out = []
    for i, (d, _) in enumerate(data):
        c = low.get(find(i)) if sets[i] else d
        out.append((d, len(sets[i]), c, c is None or d == c))
    return sorted(out, key=repr)


def found(df, **options):
    return lines(bottomk.clusters(df, **options), "doc_id", "n_shingles", "component_id", "kept")


def test_clusters(docs, rows, nothing):
    assert found(docs) == plain([(d, t) for d, t, _ in rows])
    assert found(nothing) == []


def crowd():
    """Near copies around and beyond the threshold, a passage in many documents, chains, and one text many times."""
    rng = random.Random(8)
    make = lambda n: [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(900)) for _ in range(n)]
    out, passage = [], make(60)
    for size in (30, 80, 200, 700):
        base = make(size)
        for i in range(70):
            w = list(base)
            for _ in range(rng.randrange(max(2, size // 16))):
                w[rng.randrange(size)] = "new" + str(rng.randrange(99999))
            out.append(w)
        step = list(base)
        for _ in range(25):  # a chain: each differs a little from the one before
            step = [x if rng.random() > 0.012 else "step" + str(rng.randrange(99999)) for x in step]
            out.append(step)
        out += [base] * 20
    out += [passage + make(rng.randrange(5, 90)) for _ in range(120)]
    out += [make(2), make(1), ["one"], ["ONE"], ["one", "two"], []]
    rng.shuffle(out)
    data = [(i * 7 % 5003, " ".join(w)) for i, w in enumerate(out)]
    return [*data, (None, data[3][1]), (None, "only here and without any id"), data[5], (9999, None)]


@pytest.mark.parametrize("k,tile_rows,pair_rows,common,percent,width", [(64, 40, 3, 0, 85, 3), (128, 4096, 256, 100_000, 60, 2)])
def test_crowd(spark, monkeypatch, k, tile_rows, pair_rows, common, percent, width):
    monkeypatch.setattr(bottomk, "TILE_ROWS", tile_rows)
    monkeypatch.setattr(bottomk, "PAIR_ROWS", pair_rows)
    monkeypatch.setattr(bottomk, "COMMON", common)
    monkeypatch.setattr(bottomk, "BUCKET_BYTES", 100_000)
    monkeypatch.setattr(bottomk._tiles, "__defaults__", (16,))
    data = crowd()
    df = spark.createDataFrame([(d, t, "r", "x", 1) for d, t in data], "doc_id long, text string, row string, id string, n int").repartition(3)
    assert found(df, k=k, percent=percent, width=width) == plain(data, percent, width)


def test_filters_keep_all_links():
    """No similar pair fails the prefix, the estimate or the parity bound, at sizes below and beyond the sketch."""
    rng = np.random.default_rng(5)
    kept = 0
    for _ in range(3000):
        size = int(rng.choice([1, 3, 10, 60, 64, 66, 75, 300, 900]))
        both = rng.integers(0, 1 << 63, size).astype(np.uint64)
        x, y = (np.unique(np.concatenate([both, rng.integers(0, 1 << 63, int(rng.integers(0, size // 5 + 1))).astype(np.uint64)])) for _ in range(2))
        shared = len(np.intersect1d(x, y))
        if 100 * shared < 85 * (len(x) + len(y) - shared):
            continue
        kept += 1
        assert bottomk.may_be_similar(len(x), x[:64], len(y), y[:64])
        assert bottomk.may_be_similar(len(x), bottomk.brief(x[:64]), len(y), bottomk.brief(y[:64]))
        p, q = (s[:64][: bottomk.prefix_size(len(s), 64)] for s in (x, y))
        assert len(np.intersect1d(p, q))
        a, b = (np.frombuffer(bottomk.parity(s[:512]), np.uint64) for s in (x, y))
        apart = np.bitwise_count(a ^ b).sum()
        assert apart <= bottomk.most_apart(np.array([len(x)]), np.array([len(y)]))[0]
    assert kept > 500


def test_least_shared_is_a_tail():
    assert 0 < bottomk.least_shared(64) < bottomk.least_shared(64, tail=1e-3) < 64 * 0.85


def family(rng, size, copies, changed):
    """Sets that each have ``changed`` values of their own in place of the common ones."""
    base = rng.integers(0, 1 << 63, size).astype(np.uint64)
    return [np.unique(np.concatenate([rng.permutation(base)[changed:], rng.integers(0, 1 << 63, changed).astype(np.uint64)])) for _ in range(copies)]


def listed(sets):
    zero = [0] * len(sets)
    return pa.table({"v": zero, "i": zero, "j": zero, "part": zero, "id": [*range(len(sets))], "root": [*range(len(sets))], "n": [len(x) for x in sets], "bits": [bottomk.parity(x[: bottomk.MAP_K]) for x in sets]})


@pytest.mark.parametrize("size", [600, 1500, 5000])
def test_a_family_below_the_threshold_gives_no_pairs(size):
    """Large near copies of one text, each pair at 0.75 or less: their number of candidates does not grow with its square."""
    sets = family(np.random.default_rng(size), size, 40, size // 6)
    assert bottomk._tiles(85)(listed(sets)).num_rows == 0


def test_tiles_keep_similar_sets_of_maps_of_two_lengths():
    rng = np.random.default_rng(2)
    for size in (1000, 2020, 4090):
        base = np.unique(rng.integers(0, 1 << 63, size + 60).astype(np.uint64))
        sets = [base[k : size + 60 - k] for k in range(0, 40, 4)]
        got = bottomk._tiles(85, 4)(listed(sets))
        near = {(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))}
        assert len({len(bottomk.parity(x)) for x in sets}) == 2 and near <= set(zip(got["a"].to_pylist(), got["b"].to_pylist(), strict=True))


@pytest.mark.parametrize("changed", [27, 20])
def test_a_family_near_the_threshold_gives_fewer_pairs_than_sets(changed):
    """Sets of 0.82 to 0.85, which parity bits do not tell, and of more: full sets are compared where they meet, and only joins are kept."""
    sets = family(np.random.default_rng(changed), 600, 60, changed)
    table = listed(sets)
    assert bottomk._tiles(85)(table).num_rows > 500
    near = [(i, j) for j in range(60) for i in range(j) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))]
    got = bottomk._tiles(85, 16)(table.append_column("data", pa.array([x.tobytes() for x in sets])))
    pairs = list(zip(got["a"].to_pylist(), got["b"].to_pylist(), strict=True))
    root = list(range(60))
    for a, b in near:
        root = [root[a] if x == root[b] else x for x in root]
    assert set(pairs) <= set(near) and len(pairs) == 60 - len(set(root)) and (len(pairs) == 59) == (changed == 20)
    marked = bottomk._tiles(85, marks=True)(table)
    assert marked.num_rows == 60 and sorted(marked["id"].to_pylist()) == [*range(60)]
