"""Copies of pictures against a comparison of all pairs, on crowded keys and on odd rows."""

import numpy as np
import pandas as pd

from tidemark.llm import image_local as il
from tidemark.llm.common import components

SMALL = "/root/testdata/sf0.001"


def _images(pictures):
    spots = [il.packed(*il.corners(np.rint(p), il.tests())) for p in pictures]
    return spots, [il.Image(*s) for s in spots]


def _drawn(n, seed=0):
    rng = np.random.default_rng(seed)
    return [il.picture(rng.normal(size=64)) for _ in range(n)]


def _classes(names, pairs):
    root = {n: n for n in names}
    for a, b in pairs:
        old, new = sorted((root[a], root[b]), reverse=True)
        root = {n: new if r == old else r for n, r in root.items()}
    return root


def _links(spark, spots):
    table = pd.DataFrame({"image": range(len(spots)), "spots": [s for s, _ in spots], "bits": [b for _, b in spots]})
    got = il.links(spark.createDataFrame(table, "image long, spots array<long>, bits array<long>"))
    return _classes(range(len(spots)), [(r.a, r.b) for r in got.collect()])


def test_links_join_what_all_pairs_join(spark, monkeypatch):
    pictures = _drawn(60)
    pictures += [il.edited(np.rint(p), i % 8) for i, p in enumerate(pictures[:40])]
    spots, images = _images(pictures)
    want = _classes(range(100), [(i, j) for i in range(100) for j in range(i + 1, 100) if il.alike(images[i], images[j])])
    assert _links(spark, spots) == want and len(set(want.values())) <= 64
    monkeypatch.setattr(il, "JOINED", 1)
    monkeypatch.setattr(il, "BLOCK", 4)
    assert _links(spark, spots) == want


def test_strangers_on_a_key_do_not_change_a_link(spark):
    a = _drawn(1, 5)[0]
    spots, images = _images([a, il.edited(np.rint(a), 0)])
    strangers = [([int(k) << 44 | 20 << 28 | 1000 << 14 | k], spots[0][1][:3]) for k in range(70)]
    assert il.alike(*images)
    roots = _links(spark, spots + strangers)
    assert roots[1] == 0 and len(set(roots.values())) == 71


def test_keys_are_equal_where_the_parts_are():
    bit = np.random.default_rng(1).random((3, il.WIDTH * il.TABLES)) < 0.5
    other = bit.copy()
    other[:, il.WIDTH + 3] ^= True
    one, two = (il.part_keys(np.array(il.packed(np.ones((3, 4)), b)[1], np.int64).reshape(-1, il.TABLES)).reshape(3, il.TABLES) for b in (bit, other))
    assert ((one == two) == [True, False, True]).all() and len(set(one.ravel())) == one.size


def test_edited_pictures_are_found_and_odd_rows_kept(spark):
    media = il.media_of(spark.read.parquet(f"{SMALL}/embeddings.parquet").limit(120))
    odd = spark.createDataFrame([(-1, None), (-2, None), (-3, b"junk"), (-3, b"junk"), (None, b"P5\n2 2\n255\n")], "media_id long, data binary")
    rows = media.unionByName(odd).selectExpr("*", "1 AS bytes", "2 AS image", "3 AS spots")
    got = il.copies(rows).toPandas()
    by = got.drop_duplicates("media_id").set_index("media_id").class_id
    edits = [i for i in by.index if i > 0 and i % 2]
    assert len(got) == 120 + len(edits) + 5 and by[-1] == by[-2] == -2 and by[-3] == -3
    assert np.mean([by[i] == by[i - 1] for i in edits]) >= 0.9 and by.nunique() >= 120
    assert il.copies(rows.limit(0)).count() == 0 and il.media_of(spark.read.parquet(f"{SMALL}/embeddings.parquet").limit(0)).count() == 0
    assert components(il.links(spark.createDataFrame([], "image long, spots array<long>, bits array<long>"))).count() == 0
