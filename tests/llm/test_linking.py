"""Links found region by region: nothing alike is ruled out, and what moves grows with the members, not with their square."""

import numpy as np
import pandas as pd
import pytest

from slotline.llm import lines, linking, ngram_join
from slotline.session import Staging


def near_copies(seed, n, size=120):
    """Sets of whole numbers with likenesses on both sides of 75 %."""
    r = np.random.default_rng(seed)
    base = r.integers(-(2**63), 2**63 - 1, size)
    out = []
    for _ in range(n):
        own = base[r.random(size) < r.uniform(0.7, 1)]
        out.append(np.unique(np.append(own, r.integers(-(2**63), 2**63 - 1, r.integers(1, 12)))))
    return out


def alike(x, y, percent=75):
    both = len(np.intersect1d(x, y))
    return both * 100 >= (len(x) + len(y) - both) * percent


def brute(sets):
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    return root


@pytest.mark.parametrize("percent", [40, 75, 85])
def test_bitmaps_rule_out_no_pair_that_is_alike(percent):
    sets = near_copies(1, 40) + near_copies(2, 20, 700) + near_copies(3, 20, 250) + [np.array([5]), np.array([5, 6])]
    maps = linking.Bitmaps(np.array([len(s) for s in sets]), [linking.bitmap(s) for s in sets], percent)
    i, j = np.triu_indices(len(sets), 1)
    possible = maps.possible(i, j)
    real = np.array([alike(sets[a], sets[b], percent) for a, b in zip(i, j)])
    assert real.any() and possible[real].all()
    # Unrelated sets of one size are ruled out, also large ones.
    r = np.random.default_rng(4)
    far = [r.integers(-(2**63), 2**63 - 1, n) for n in (3, 100, 500, 513, 6000, 8191) for _ in range(4)]
    maps = linking.Bitmaps(np.array([len(s) for s in far]), [linking.bitmap(s) for s in far], 75)
    assert not maps.possible(*np.triu_indices(len(far), 1)).any()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_exact_cells_equal_brute_force(seed):
    sets = near_copies(seed, 60)
    found = linking.connected(np.arange(60), linking.Ring(sets, 75).near)
    want = brute(sets)
    assert len(set(zip(found, want))) == len(set(found)) == len(set(want)) > 1


def test_cells_stay_whole_across_batches():
    r = np.random.default_rng(1)
    cell = np.sort(r.integers(0, 12, 300))
    cuts = [0, *np.sort(r.integers(0, 300, 25)).tolist(), 300]
    frames = [pd.DataFrame({"cell": cell[a:b], "x": np.arange(a, b)}) for a, b in zip(cuts, cuts[1:])]
    seen, cells = [], []
    for rows, ends in linking.whole_cells(iter(frames)):
        seen += rows["x"].tolist()
        for a, b in zip(ends[:-1], ends[1:]):
            assert rows["cell"].iloc[a:b].nunique() == 1
            cells.append(rows["cell"].iloc[a])
    assert seen == list(range(300)) and cells == np.unique(cell).tolist()


def test_regions_with_the_same_members_are_one(spark):
    rows = [(r, i) for r in range(50) for i in (7, 8)] + [(90, 7), (90, 7), (91, 9), (92, 7), (92, 8), (92, 9)]
    out = linking.shared_regions(spark.createDataFrame(rows, "region long, item long").repartition(4), len(rows)).collect()
    groups = {}
    for r in out:
        groups.setdefault(r["group"], []).append(r["item"])
    assert sorted(sorted(g) for g in groups.values()) == [[7, 8], [7, 8, 9]]


def test_large_groups_of_copies_are_dealt_once(spark, monkeypatch):
    """300 members that are all connected and 5 that are not: chunks are not dealt two by two."""
    monkeypatch.setattr(linking, "CELL", 20)
    dealt = spark.sparkContext.accumulator(0)

    def compare(frames):
        for rows, ends in linking.whole_cells(frames):
            dealt.add(len(rows))
            item, root = rows["item"].to_numpy(), rows["root"].to_numpy()
            a, b = [], []
            for x, y in zip(ends[:-1], ends[1:]):
                own = item[x:y]
                # Member 300 is near member 17 only, 301 near 300 only; the rest of the odd ones near nothing.
                near = lambda p, rest, own=own: np.array([max(own[p], q) < 300 and abs(own[p] - q) < 300 or {own[p], q} in ({17, 300}, {300, 301}) for q in own[rest]], bool)
                a.append(own)
                b.append(own[linking.connected(root[x:y], near)])
            yield linking.as_links(a, b)

    members = spark.createDataFrame([(1, k, 0) for k in range(305)] + [(2, 400, 0), (2, 401, 0)], "group long, item long, load long")
    payload = members.select("item")
    with Staging(spark, "test") as held:
        out = {r["node"]: r["root"] for r in linking.linked(members, payload, compare, held, "t").collect()}
    assert {k for k, v in out.items() if v == 0} == set(range(302))
    assert all(out.get(k, k) == k for k in (302, 303, 304, 400, 401))
    assert dealt.value < 1500  # 305 * 16 when chunks meet two by two


def test_line_bands_are_the_same_in_any_chunks(monkeypatch):
    many = [f"{k} " * (1 + k % 30) for k in range(200)]
    whole = lines.band_keys(many)
    monkeypatch.setattr(lines, "CHUNK", 50)
    parts = list(lines.in_chunks(many))
    assert len(parts) > 10 and (np.concatenate([lines.band_keys(p) for p in parts]) == whole).all()
    assert all((a == np.unique(lines.shingle_hashes([x])[0]).view(np.int64)).all() for a, x in zip(lines.sets_of(many), many))


def test_unlike_documents_that_share_a_passage_stay_apart(spark):
    """400 texts share a passage that all their prefixes reach into, and no two are alike."""
    r = np.random.default_rng(9)
    shared = " ".join(f"s{k}" for k in range(60))
    texts = [shared + " " + " ".join(f"w{r.integers(10**9)}" for _ in range(40)) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {x["doc_id"]: x["component_id"] for x in ngram_join.report(docs).collect()}
    assert out == {k: k for k in range(400)}
