import numpy as np

from millrace.llm import embedding_dedup as ed

from .test_common import union_find

SCHEMA = "vec_id long, embedding array<float>, label int, id long, v string, copies long, component long"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, 1, "x", 2, 3) for i, v, lab in rows], SCHEMA)


def brute(rows, threshold):
    good = []
    for k, (i, v, lab) in enumerate(rows):
        if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v):
            u = np.asarray(v, np.float32).astype(np.float64)
            good.append((k, i, lab, u / np.linalg.norm(u)))
    links, edges = [0] * len(rows), []
    for x, (k, i, lab, u) in enumerate(good):
        for m, j, other, w in good[x + 1 :]:
            if lab == other and len(u) == len(w) and u @ w >= threshold:
                links[k] += 1
                links[m] += 1
                edges.append((i, j))
    comp = union_find([e for e in edges if e[0] != e[1]])
    return sorted(((i, links[k], comp.get(i, i)) for k, (i, _, _) in enumerate(rows)), key=str)


def check(spark, rows, **how):
    got = ed.similar(frame(spark, rows), **how).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=str) == brute(rows, ed.THRESHOLD)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_groups_against_brute_force_in_small_blocks(spark):
    rng = np.random.default_rng(2)
    rows = []
    for label in (0, 1):
        centre = rng.normal(size=32)
        rows += [(len(rows) + i, [float(x) for x in centre + rng.normal(size=32) * rng.choice([0.1, 0.25, 0.3])], label) for i in range(90)]
        rows += [(1000 * (label + 1) + i, [float(x) for x in rng.normal(size=32)], label) for i in range(60)]
    rows += [(5000 + i, rows[0][1], 0) for i in range(30)]  # copies
    rows += [(6000 + i, [2 * x for x in rows[0][1]], 0) for i in range(3)]
    check(spark, rows, block=16)
    check(spark, rows)


def test_clusters_are_linked_and_counted_without_products(spark):
    rng = np.random.default_rng(5)
    centre, other = rng.normal(size=24), rng.normal(size=24)
    rows = [(i, [float(x) for x in centre + rng.normal(size=24) * rng.choice([0.02, 0.05, 0.2, 0.35])], 1) for i in range(220)]
    rows += [(300 + i, [float(x) for x in other + rng.normal(size=24) * 0.03], 1) for i in range(150)]
    rows += [(600 + i, [float(x) for x in (centre + other) / 2 + rng.normal(size=24) * 0.3], 1) for i in range(60)]
    rows += [(700 + i, rows[3][1], 1) for i in range(9)] + [(800 + i, rows[300][1], 2) for i in range(3)]
    rows += [(900 + i, [float(x) for x in rng.normal(size=24)], 1) for i in range(80)]
    for block in (8, 24):
        check(spark, rows, block=block)


def test_tables_grow_slowly_and_leave_out_few():
    for bits in range(1, 25):
        agree = (1 - np.arccos(0.93) / np.pi) ** bits
        assert (1 - agree) ** ed.tables_for(bits) <= ed.MISS < (1 - agree) ** (ed.tables_for(bits) - 1)
    # sixteen times the vectors: less than twice the tables from a million on
    assert ed.tables_for(18) < 2 * ed.tables_for(14)
    assert ed.tables_for(8, threshold=1.0) == 1


def test_recall_at_the_threshold_and_growth():
    rng = np.random.default_rng(1)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    a = unit(rng.standard_normal((5000, 64)))
    b = rng.standard_normal(a.shape)
    b = unit(b - (a * b).sum(axis=1, keepdims=True) * a)
    c = rng.uniform(0.93, 0.94, (len(a), 1))
    near = c * a + np.sqrt(1 - c * c) * b
    for bits in (4, 6, 8, 12):
        tables = ed.tables_for(bits)
        met = (ed.sign_hashes(a, tables, bits) == ed.sign_hashes(near, tables, bits)).any(axis=1)
        assert met.mean() >= 0.999
    # four times the vectors: at most 6.5 times the products, where all pairs would be 16 times as many
    products = []
    for n, bits in ((4000, 5), (16_000, 7)):
        signs = ed.sign_hashes(rng.standard_normal((n, 64)), ed.tables_for(bits), bits)
        products.append(sum(int((np.bincount(t).astype(np.int64) ** 2).sum()) for t in signs.T))
    assert products[1] <= 6.5 * products[0]


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [1.0, 0.01], 1), (4, [1.0, 0.0], 2), (5, [1.0, 0.0], None), (6, None, 1), (7, [], 1), (8, [0.0, 0.0], 1), (9, [1.0, nan], 1), (10, [inf, 1.0], 1), (11, [1.0, None], 1), (12, [1.0, 0.0, 0.0], 1), (13, [-1.0, 0.0], 1), (None, [1.0, 0.0], 1), (14, [1e-30, 0.0], 1), (15, [3e38, 3e36], 1)]
    check(spark, rows)


def test_empty_table(spark):
    assert ed.similar(frame(spark, [])).count() == 0


def test_forest_spans_its_graph():
    rng = np.random.default_rng(4)
    for _ in range(20):
        hit = rng.random((25, 25)) < 0.06
        hit |= hit.T
        np.fill_diagonal(hit, False)
        edges = [(int(a), int(b)) for x, y in ed.forest(hit) for a, b in zip(x, y)]
        want = union_find([(int(a), int(b)) for a, b in zip(*np.nonzero(hit))])
        assert union_find(edges) == want and len(edges) == len(want) - len(set(want.values()))
