"""SimHash classes and components against brute force."""

from collections import Counter

import numpy as np
import xxhash

from hourpanel.llm import components, simhash_dedup

from .conftest import rows_of


def brute_fp(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(rows, fps):
    """Smallest id reachable over pairs at 4 bits or fewer; all pairs compared."""
    n = len(rows)
    f = np.array(fps, np.uint64)
    group = list(range(n))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(n):
        for j in np.flatnonzero(np.bitwise_count(f[:i] ^ f[i]) <= 4):
            group[root(int(j))] = root(i)
    least = {}
    for i in range(n):
        ids = [r[0] for k, r in enumerate(rows) if root(k) == root(i) and r[0] is not None] if root(i) not in least else [least[root(i)]]
        least[root(i)] = min((x for x in ids if x is not None), default=None)
    return [least[root(i)] for i in range(n)]


def test_classes_equal_brute_force(edge, small):
    for df in (edge, small):
        rows = rows_of(df.select("doc_id", "text"))
        fps = [brute_fp(t) for _, t in rows]
        want = Counter((r[0], f"{f:016x}", c) for r, f, c in zip(rows, fps, brute_classes(rows, fps)))
        assert Counter(rows_of(simhash_dedup.near_duplicate_classes(df))) == want
        left = simhash_dedup.drop_near_duplicates(df)
        assert left.columns == df.columns
        assert Counter(r.doc_id for r in left.collect()) == Counter(r[0] for r in want.elements() if r[0] is None or r[0] == r[2])
    assert simhash_dedup.near_duplicate_classes(edge.limit(0)).count() == 0


def test_one_text_stays_under_a_repeated_id(spark):
    """Near-equal texts under one smallest id leave one; a far text under the same id is another group."""
    near = ["some plain words stand here", "Some plain words stand here", "some  plain words stand here"]
    rows = [(7, near[0]), (7, near[1]), (9, near[2]), (7, "quite other things were said of it at length"), (None, near[2])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = rows_of(simhash_dedup.drop_near_duplicates(df))
    assert sum(r[0] == 7 and r[1] in near for r in left) == 1
    assert Counter(r for r in left if r[1] not in near or r[0] != 7) == Counter(rows[3:])


def test_links_of_planted_fingerprints(spark):
    """A crowd around one centre, chains of near fingerprints, and far ones: components as by brute force, for several distances."""
    rng = np.random.default_rng(5)
    centre = int(rng.integers(1 << 62))

    def flip(x, k):
        for b in rng.choice(64, k, replace=False):
            x ^= 1 << int(b)
        return x

    fps = {0, centre, *[flip(centre, int(rng.integers(1, 6))) for _ in range(400)], *[int(x) for x in rng.integers(1 << 63, size=300)]}
    for _ in range(20):
        x = int(rng.integers(1 << 63))
        for _ in range(6):
            fps.add(x)
            x = flip(x, 4)
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp long").repartition(5)
    u = np.array(fps).view(np.uint64)
    for bits, block in ((0, simhash_dedup.LIST_BLOCK), (3, simhash_dedup.LIST_BLOCK), (4, simhash_dedup.LIST_BLOCK), (4, 40)):
        edges = rows_of(simhash_dedup.links(df, bits, block))
        assert block == 40 or len(edges) <= 70 * len(fps)
        got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()} if edges else {}
        rows = [(x,) for x in fps]
        group = brute_pairs(u, bits)
        want = {}
        for i, g in enumerate(group):
            want.setdefault(g, []).append(fps[i])
        for members in want.values():
            assert {got.get(m, m) for m in members} == {min(members)}, (bits, rows[:1])


def test_a_list_longer_than_a_block_is_cut(spark):
    """Fingerprints that share their upper half meet in one list; cut into blocks, its links have the same components."""
    rng = np.random.default_rng(11)
    fps = np.unique(rng.integers(1 << 16, size=3000) << 16 | rng.integers(1 << 16, size=3000) | 0x1234567800000000)
    df = spark.createDataFrame([(int(x),) for x in fps], "fp long").repartition(3)
    cut = simhash_dedup._search_lists(simhash_dedup.index_entries(df, 4).repartition(2, "mask", "bytes").sortWithinPartitions("mask", "bytes"), 4, 500)
    whole = Counter((r["mask"], r["bytes"]) for r in cut.where("v is null").collect())
    assert whole[(-1 << 32, 0x1234567800000000)] == len(fps)
    assert cut.where("v is null").groupBy("mask", "bytes", "block").count().agg({"count": "max"}).first()[0] == 500
    got = {r.node: r.root for r in components.components(simhash_dedup.links(df, 4, 500)).collect()}
    want = {}
    for i, g in enumerate(brute_pairs(fps.view(np.uint64), 4)):
        want.setdefault(g, []).append(int(fps[i]))
    assert len(want) > 1
    for members in want.values():
        assert {got.get(m, m) for m in members} == {min(members)}


def brute_pairs(u, bits):
    group = np.arange(len(u))
    for i in range(len(u)):
        near = np.flatnonzero(np.bitwise_count(u ^ u[i]) <= bits)
        for g in set(group[near].tolist()) - {int(group[i])}:
            group[group == g] = group[i]
    return group.tolist()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, x) for x in range(501, 560)] + [(9, 9), (7, 3), (3, 7), (7, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 500 for i in range(500, 560)} | {3: 3, 7: 3}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0
