import numpy as np

from tallyweave.llm import media as m

RNG = np.random.default_rng(3)
VECTORS = [RNG.normal(size=16).astype(float).tolist() for _ in range(120)]


def brute(image, query):
    """Inliers with every pair of corners compared."""
    (a, p), (b, q) = m.describe(m.pixels_of(query)), m.describe(m.pixels_of(image))
    if not len(a) or not len(b):
        return 0
    one, two = np.nonzero(np.bitwise_count(a[:, None] ^ b[None]).sum(axis=2) <= m.DISTANCE)
    rows = np.concatenate([one[:, None], two[:, None], p[one], q[two]], axis=1)
    return m.consensus(rows) if len(rows) >= m.INLIERS else 0


def test_recall_against_brute_force(spark):
    images = [m.render(v) for v in VECTORS]
    queries = [m.edited(images[k]) for k in range(0, 120, 4)]
    want = {(4 * i, k) for i, q in enumerate(queries) for k, image in enumerate(images) if brute(image, q) >= m.INLIERS}
    assert {(4 * i, 4 * i) for i in range(30)} <= want
    t = spark.createDataFrame([(k, bytearray(x), "c") for k, x in enumerate(images)], "image_id long, image binary, corner string").repartition(4)
    q = spark.createDataFrame([(4 * k, bytearray(x)) for k, x in enumerate(queries)], "image_id long, image binary")
    got = {(r.query_id, r.image_id) for r in m.find_copies(t, q).collect()}
    assert got <= want and len(got) >= 0.9 * len(want)


def test_turned_and_shrunk_copies():
    hits = 0
    for v in VECTORS[:20]:
        image = m.render(v)
        a = m.pixels_of(image)
        hits += brute(image, m.pgm(np.rot90(a))) >= m.INLIERS
        hits += brute(image, m.pgm(m._resized(a.astype(float), 0.75))) >= m.INLIERS
        assert brute(image, m.render(VECTORS[40])) < m.INLIERS
    assert hits >= 36


def test_query_and_odd_rows(spark):
    rows = [(k, v) for k, v in enumerate(VECTORS)] + [(200 + k, VECTORS[0]) for k in range(30)] + [(300, None), (None, VECTORS[1]), (7, VECTORS[7])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, class_id int").repartition(3)
    got = m.drawn_copies(df, every=10).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.vec_id is None or r.vec_id == 300:
            assert not r.found
            continue
        assert r.class_id == (0 if r.vec_id >= 200 else r.vec_id)
        assert r.query_id == (r.class_id if r.vec_id % 10 == 0 else None)
    asked = [r for r in got if r.query_id is not None and r.vec_id != 300]
    assert np.mean([bool(r.found) and r.found[0].class_id == r.class_id for r in asked]) >= 0.9
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert m.drawn_copies(empty).collect() == []
    small = spark.createDataFrame([(1, bytearray(b"junk")), (2, bytearray(m.pgm(np.zeros((5, 5))))), (3, None), (4, bytearray(m.pgm(np.zeros((60, 60)))))], "image_id long, image binary")
    assert m.find_copies(small, small).collect() == []


def turned(pixels, degrees):
    """The picture turned about its middle, edges repeated."""
    a, angle = pixels.astype(float), np.deg2rad(degrees)
    y, x = np.mgrid[: a.shape[0], : a.shape[1]] - (np.array(a.shape) - 1).reshape(2, 1, 1) / 2
    v = np.clip(y * np.cos(angle) - x * np.sin(angle) + (a.shape[0] - 1) / 2, 0, a.shape[0] - 1.001)
    u = np.clip(y * np.sin(angle) + x * np.cos(angle) + (a.shape[1] - 1) / 2, 0, a.shape[1] - 1.001)
    i, k = v.astype(int), u.astype(int)
    fy, fx = v - i, u - k
    return (a[i, k] * (1 - fx) + a[i, k + 1] * fx) * (1 - fy) + (a[i + 1, k] * (1 - fx) + a[i + 1, k + 1] * fx) * fy


def test_corners_of_small_turns_agree():
    for degrees in (5, 8, 11, 14, 20, -11):
        places = RNG.uniform(0, 100, (20, 2))  # y, x
        a = np.deg2rad(degrees)
        seen = places @ np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]])
        step = round(degrees / 360 * m.TURNS) % m.TURNS
        rows = np.column_stack([np.arange(20), np.arange(20), places, np.zeros((20, 2)), seen, np.zeros(20), np.full(20, step)])
        assert m.consensus(rows) == 20, degrees


def test_slightly_turned_crops_are_found():
    hits = 0
    for v in VECTORS[:10]:
        image = m.render(v)
        for degrees in (5, 8, 11, 14, 17, 20):
            hits += brute(image, m.edited(m.pgm(turned(m.pixels_of(image), degrees)))) >= m.INLIERS
    assert hits >= 54


def large(seed, side):
    """A textured picture of any size, as fine as the drawings."""
    rng, a = np.random.default_rng(seed), np.zeros((side, side))
    for cells, height in ((8, 50), (20, 90), (40, 115)):
        n = cells * side // m.SIZE
        a += m._resized(rng.uniform(0, height, (n, n)), side / n)[:side, :side]
    return np.clip(m._box(a, 1), 0, 255)


def crops(pictures, side):
    """(picture, relit and noisy crop) of each picture, three for each."""
    rng = np.random.default_rng(side)
    for k, a in enumerate(pictures):
        for _ in range(3):
            y, x = rng.integers(0, len(a) - side + 1, 2)
            yield k, m.pgm(np.clip(a[y : y + side, x : x + side] * 0.9 + 8 + rng.normal(0, 2, (side, side)), 0, 255))


def test_crops_of_large_pictures(monkeypatch):
    pictures = [large(k, 448) for k in range(4)]
    whole = [m.pgm(a) for a in pictures]
    for side in (112, 84):
        asked = list(crops(pictures, side))
        got = [brute(whole[k], q) >= m.INLIERS for k, q in asked]
        with monkeypatch.context() as all_corners:
            all_corners.setattr(m, "CORNERS", 1 << 30)
            want = [brute(whole[k], q) >= m.INLIERS for k, q in asked]
        assert sum(want) >= 11 and sum(got) >= 0.9 * sum(want)


def test_corners_grow_with_the_pixels():
    few, many = (len(m.describe(large(1, side))[0]) for side in (224, 448))
    assert many > 3 * few > 3 * 3 * m.CORNERS
