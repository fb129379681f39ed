"""Copies of images, cropped or edited, by local descriptors.

Corners are found at several scales, each gets the orientation of its patch's intensity centroid, and 192 rotated
binary tests describe it: which of two points is brighter, once the patch's own slope is taken off. The
descriptors' three 64-bit parts key three Hamming tables. Images that share SHARED keys or more are compared in full: corners
within MATCH bits vote for the similarity transform that takes one to the other, and AGREE corners that agree on
one link the images. Equal bytes are one image.

A link is a property of two images alone. Keys of few images are joined; a key of many is first joined up along
centres, and what is still apart then meets block by block, in tasks that return spanning forests.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, components, saved

#: The strongest corners of an image that are described (what the features of an image are, not a cap on partners).
CORNERS = 32
SCALES = (1.0, 0.75, 0.5625)
MATCH = 28
#: Bits of a part. Of 1,124,250 pairs of different pictures 1,405 share a part of 48 bits, 23 one of 64.
WIDTH = 64
TABLES = 3
#: Keys that two images must share to be compared. Edited copies share 8 or more, 19 in 20 of them.
SHARED = 4
#: Corners of one image that must agree on a transform.
AGREE = 6
#: A key of more images than this is compared along centres and by blocks instead of by a join.
JOINED = 64
BLOCK = 256
_RADIUS = 9


def decode_pgm(data: bytes | None) -> np.ndarray | None:
    """Grey pixels of a binary PGM, or None for anything else."""
    if not data or data[:2] != b"P5":
        return None
    try:
        head, at = [], 2
        while len(head) < 3:
            while data[at : at + 1].isspace():
                at += 1
            end = at
            while not data[end : end + 1].isspace():
                end += 1
            head.append(int(data[at:end]))
            at = end
        width, height, _ = head
        return np.frombuffer(data, np.uint8, width * height, at + 1).reshape(height, width)
    except (ValueError, IndexError):
        return None


def encode_pgm(pixels: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + np.clip(pixels, 0, 255).astype(np.uint8).tobytes()


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Mean over a square of 2 r + 1 pixels, edges repeated."""
    p = np.pad(a, r + 1, mode="edge").cumsum(0).cumsum(1)
    k = 2 * r + 1
    return (p[k:-1, k:-1] - p[: -k - 1, k:-1] - p[k:-1, : -k - 1] + p[: -k - 1, : -k - 1]) / (k * k)


def resized(a: np.ndarray, scale: float) -> np.ndarray:
    """Bilinear."""
    h, w = max(1, round(a.shape[0] * scale)), max(1, round(a.shape[1] * scale))
    y, x = np.clip((np.arange(h) + 0.5) / scale - 0.5, 0, a.shape[0] - 1), np.clip((np.arange(w) + 0.5) / scale - 0.5, 0, a.shape[1] - 1)
    y0, x0 = np.minimum(y.astype(int), max(0, a.shape[0] - 2)), np.minimum(x.astype(int), max(0, a.shape[1] - 2))
    y1, x1 = np.minimum(y0 + 1, a.shape[0] - 1), np.minimum(x0 + 1, a.shape[1] - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    return (a[y0][:, x0] * (1 - fx) + a[y0][:, x1] * fx) * (1 - fy) + (a[y1][:, x0] * (1 - fx) + a[y1][:, x1] * fx) * fy


_DISC = np.array([(y, x) for y in range(-6, 7) for x in range(-6, 7) if y * y + x * x <= 36])


@lru_cache
def tests() -> np.ndarray:
    """192 pairs of points (y, x) in the patch, the same in every session: of random ones those that tell drawn pictures apart.

    Pairs that split the corners of 60 pictures most evenly go first, and one that agrees with an earlier pair too often is left out.
    """
    rng = np.random.default_rng(7)
    pool = np.clip(rng.normal(0, _RADIUS / 2, (3000, 2, 2)), -_RADIUS + 1, _RADIUS - 1)
    pool = pool[np.hypot(*(pool[:, 0] - pool[:, 1]).T) > 2][:2000]
    bits = np.concatenate([corners(picture(rng.normal(size=64)), pool, 48)[1] for _ in range(60)]).astype(float)
    scaled = (bits - bits.mean(0)) / np.maximum(bits.std(0), 1e-9)
    alike, order, chosen = np.abs(scaled.T @ scaled) / len(bits), np.argsort(np.abs(bits.mean(0) - 0.5), kind="stable"), []
    for most in np.arange(0.2, 1.01, 0.05):
        free, chosen = np.ones(len(pool), bool), []
        for i in order:
            if free[i]:
                chosen.append(i)
                free &= alike[i] < most
        if len(chosen) >= WIDTH * TABLES:
            break
    return pool[rng.permutation(chosen[: WIDTH * TABLES])]


def corners(image: np.ndarray, pairs: np.ndarray, most: int = CORNERS) -> tuple[np.ndarray, np.ndarray]:
    """(n, 4) of y, x, scale, angle in the image's own pixels, and (n, len(pairs)) bits. Small or flat images have none."""
    places, bits = [], []
    for scale in SCALES:
        a = _box(resized(image.astype(float), scale) if scale != 1 else image.astype(float), 1)
        edge = _RADIUS + 3
        if min(a.shape) <= 2 * edge:
            break
        gy, gx = np.gradient(a)
        xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        harris = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        inner = harris[edge:-edge, edge:-edge]
        top = inner > 1e2
        for dy in range(-2, 3):
            for dx in range(-2, 3):
                if dy or dx:
                    other = harris[edge + dy : harris.shape[0] - edge + dy, edge + dx : harris.shape[1] - edge + dx]
                    top &= (inner > other) | (inner == other) & ((dy, dx) > (0, 0))
        y, x = np.nonzero(top)
        if not len(y):
            continue
        strength, y, x = inner[y, x], y + edge, x + edge
        order = np.argsort(-strength, kind="stable")[:most]
        strength, y, x = strength[order], y[order], x[order]
        patch = a[y[:, None] + _DISC[:, 0], x[:, None] + _DISC[:, 1]]
        patch = patch - patch.mean(1, keepdims=True)
        my, mx = patch @ _DISC[:, 0], patch @ _DISC[:, 1]
        angle, slope = np.arctan2(my, mx), np.hypot(my, mx) / (_DISC[:, 1] ** 2).sum()
        c, s = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
        ty, tx = pairs[None, :, :, 0], pairs[None, :, :, 1]
        py = np.clip(np.rint(y[:, None, None] + s * tx + c * ty).astype(int), 0, a.shape[0] - 1)
        px = np.clip(np.rint(x[:, None, None] + c * tx - s * ty).astype(int), 0, a.shape[1] - 1)
        value = _box(a, 1)[py, px]
        places.append(np.stack([y / scale, x / scale, np.full(len(y), 1 / scale), angle, strength], axis=1))
        bits.append(value[:, :, 0] - value[:, :, 1] < slope[:, None] * (tx[:, :, 0] - tx[:, :, 1]))
    if not places:
        return np.zeros((0, 4)), np.zeros((0, len(pairs)), bool)
    place, bit = np.concatenate(places), np.concatenate(bits)
    best = np.argsort(-place[:, 4], kind="stable")[:most]
    return place[best, :4], bit[best]


def packed(place: np.ndarray, bit: np.ndarray) -> tuple[list[int], list[int]]:
    """The corners' places as one number each, and their bits as three."""
    y, x, scale, angle = np.rint(place * [4, 4, 1000, 1000]).astype(np.int64).T % [[1 << 16], [1 << 16], [1 << 14], [6283]]
    return (y << 44 | x << 28 | scale << 14 | angle).tolist(), np.packbits(bit, axis=1).view(">u8").astype(np.uint64).view(np.int64).ravel().tolist()


def described(media: DataFrame) -> DataFrame:
    """(media_id, bytes, spots, bits): a digest of the data and the image's corners; the pixels themselves are never shuffled."""
    pairs = tests()

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_128_hexdigest

        for batch in batches:
            found = [([], []) if (pixels := decode_pgm(data)) is None else packed(*corners(pixels, pairs)) for data in batch["data"]]
            yield pd.DataFrame({"media_id": batch["media_id"], "bytes": [xxh3_128_hexdigest(d or b"") for d in batch["data"]], "spots": [s for s, _ in found], "bits": [b for _, b in found]})

    return media.select("media_id", "data").mapInPandas(describe, "media_id long, bytes string, spots array<long>, bits array<long>")


class Image:
    """What two images are compared by: their corners' places, bits, and keys."""

    __slots__ = ("bits", "keys", "place")

    def __init__(self, spots: np.ndarray, bits: np.ndarray):
        spots, words = np.asarray(spots, np.int64), np.asarray(bits, np.int64).reshape(-1, 3)
        self.place = np.stack([(spots >> 44 & 0xFFFF) / 4, (spots >> 28 & 0xFFFF) / 4, (spots >> 14 & 0x3FFF) / 1000, (spots & 0x3FFF) / 1000], axis=1)
        self.bits, self.keys = words.view(np.uint64), set(part_keys(words).tolist())


def part_keys(words: np.ndarray) -> np.ndarray:
    """The key of every table for every corner: the part, moved by a number of the table's own."""
    return (words.view(np.uint64) + np.arange(TABLES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64).ravel()


def alike(a: Image, b: Image) -> bool:
    """Whether the images share SHARED keys and AGREE corners of each agree on one similarity transform."""
    if len(a.keys & b.keys) < SHARED:
        return False
    i, j = np.nonzero(np.bitwise_count(a.bits[:, None] ^ b.bits[None]).sum(2) <= MATCH)
    if len(i) < AGREE:
        return False
    p, q = a.place[i], b.place[j]
    size, turn = q[:, 2] / p[:, 2], q[:, 3] - p[:, 3]
    c, s = np.cos(turn) * size, np.sin(turn) * size
    x, y, size = q[:, 1] - c * p[:, 1] + s * p[:, 0], q[:, 0] - s * p[:, 1] - c * p[:, 0], np.log2(size)
    off = lambda v: np.abs(v[:, None] - v[None])
    near = (off(x) < 12) & (off(y) < 12) & (off(size) < 0.6) & (np.abs((off(turn) + np.pi) % (2 * np.pi) - np.pi) < 0.5)
    spots = [np.unique(np.rint(part[:, :2]), axis=0, return_inverse=True)[1].ravel() for part in (p, q)]
    return any(min(len(set(own[row].tolist())) for own in spots) >= AGREE for row in near if row.sum() >= AGREE)


def spanning_links(names: list[int], images: list[Image], roots: list[int]) -> tuple[list[int], list[int]]:
    """Links between images of different roots that join up whatever any such links join up."""
    tree = {r: r for r in roots}

    def top(r: int) -> int:
        while tree[r] != r:
            tree[r] = r = tree[tree[r]]
        return r

    a, b = [], []
    order = sorted(range(len(names)), key=lambda k: names[k])
    for k, i in enumerate(order):
        for j in order[k + 1 :]:
            x, y = top(roots[i]), top(roots[j])
            if x != y and alike(images[i], images[j]):
                tree[x] = y
                a.append(names[i])
                b.append(names[j])
    return a, b


def _block_links(block: pd.DataFrame) -> pd.DataFrame:
    a, b = spanning_links(block["image"].tolist(), [Image(s, w) for s, w in zip(block["spots"], block["bits"])], block["root"].tolist())
    return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def _true_links(pairs: DataFrame, images: DataFrame) -> DataFrame:
    """The candidates (a, b), a < b, whose images are alike."""

    def check(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for spots_a, bits_a, spots_b, bits_b in parts:
            yield pd.Series([alike(Image(s, w), Image(t, v)) for s, w, t, v in zip(spots_a, bits_a, spots_b, bits_b)], dtype=bool)

    one, two = (images.select(F.col("image").alias(c), F.col("spots").alias(f"spots_{c}"), F.col("bits").alias(f"bits_{c}")) for c in "ab")
    return pairs.join(two, "b").join(one, "a").where(F.pandas_udf(check, "boolean")("spots_a", "bits_a", "spots_b", "bits_b")).select("a", "b")


def links(images: DataFrame) -> DataFrame:
    """(a, b): enough links between the images (image, spots, bits) to join up all that are alike. `image` names an image; rows may not repeat."""

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [np.unique(part_keys(np.asarray(w, np.int64).reshape(-1, 3))) for w in batch["bits"]]
            if found:
                yield pd.DataFrame({"key": np.concatenate(found), "image": np.repeat(batch["image"].to_numpy(), list(map(len, found)))})

    keys = saved(images.select("image", "bits").mapInPandas(keyed, "key long, image long"))
    counted = saved(keys.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"))
    keys = saved(keys.join(broadcast_if_small(counted, 1_000_000), "key"))
    few = keys.where(F.col("m") <= JOINED)
    met = few.select("key", F.col("image").alias("a")).join(few.select("key", F.col("image").alias("b")), "key").where("a < b")
    near = met.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= SHARED).select("a", "b")

    # every image of a crowded key meets the centre of its part of the key, and that the key's centre; other keys have other centres
    crowd = keys.where(F.col("m") > JOINED).withColumn("part", F.pmod(F.xxhash64("image", "key"), F.ceil(F.col("m") / JOINED)).cast("int"))
    centres = crowd.groupBy("key", "part").agg(F.min(F.struct(F.xxhash64("key", "image").alias("at"), "image")).alias("c"))
    inner = crowd.join(centres, ["key", "part"]).select(F.col("c.image").alias("a"), F.col("image").alias("b"))
    outer = centres.join(centres.groupBy("key").agg(F.min("c").alias("f")), "key").select(F.col("f.image").alias("a"), F.col("c.image").alias("b"))
    tried = inner.unionByName(outer).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    found = saved(_true_links(saved(near.unionByName(tried).distinct()), images))

    rooted = crowd.join(components(found).withColumnRenamed("node", "image"), "image", "left").withColumn("root", F.coalesce("root", "image"))
    apart = rooted.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("key")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    members = rooted.join(apart, "key").withColumn("own", F.pmod(F.xxhash64("image"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    members = members.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "image", "root").distinct().join(images, "image")
    return found.unionByName(members.groupBy("key", "i", "j").applyInPandas(_block_links, "a long, b long"))


def copies(media: DataFrame) -> DataFrame:
    """(media_id, class_id, n_class) for each row of media (media_id, data): class_id is the least media_id of the class, n_class its rows.

    Rows with equal bytes are one image and are not compared. A null, unreadable or flat image has no corners: it is
    linked only with equal bytes, nulls with nulls. Null ids keep their row and name a class only if it has no other.
    Repeated rows come back repeated, an empty table gives no rows, other columns are not looked at. A mirrored image is no copy.
    """
    seen = saved(described(media))
    images = seen.groupBy("bytes").agg(F.min("media_id").alias("least"), F.count("*").alias("n"), F.first("spots").alias("spots"), F.first("bits").alias("bits"))
    images = saved(images.withColumn("image", F.xxhash64("bytes")))
    roots = components(links(images.where(F.size("spots") >= AGREE).select("image", "spots", "bits"))).withColumnRenamed("node", "image")
    rooted = images.select("bytes", "least", "n", "image").join(roots, "image", "left").withColumn("root", F.coalesce("root", "image"))
    classes = rooted.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("n").alias("n_class"))
    named = rooted.join(classes, "root").select("bytes", "class_id", "n_class")
    return seen.select("media_id", "bytes").join(named, "bytes").select("media_id", "class_id", "n_class")


def picture(vector: np.ndarray, side: int = 96) -> np.ndarray:
    """A picture drawn from the numbers of a vector: rectangles on an uneven ground, the same for the same vector."""
    seed = np.frombuffer(np.asarray(vector, np.float32).tobytes(), np.uint32)
    rng = np.random.default_rng(seed)
    a = 120 + 45 * resized(rng.normal(size=(side // 6, side // 6)), 6) + 12 * resized(rng.normal(size=(side // 3, side // 3)), 3)
    for _ in range(8):
        cy, cx, h, w = rng.integers(4, side - 4), rng.integers(4, side - 4), rng.integers(3, 12), rng.integers(3, 12)
        a[max(0, cy - h) : cy + h, max(0, cx - w) : cx + w] += rng.integers(-70, 70)
    return a.clip(0, 255)


def edited(a: np.ndarray, how: int) -> np.ndarray:
    """0 a crop, 1 a brighter crop, 2 a quarter turn, 3 three quarters of the size, 4 a blur, 5 a box laid over, 6 noise, 7 a third cropped away."""
    if how == 4:
        return _box(a, 1)
    if how == 5:
        return np.where((np.arange(len(a)) // 12 == 5)[:, None] & (np.arange(a.shape[1]) // 60 == 0), 250, a)
    if how == 6:
        return a + np.random.default_rng(int(a.sum())).normal(0, 4, a.shape)
    if how == 7:
        return a[10:-4, 14:]
    if how == 0:
        return a[8:, 6:]
    if how == 1:
        return a[:-10, 4:-4] * 0.85 + 25
    return np.rot90(a) if how == 2 else resized(a, 0.75)


def media_of(embeddings: DataFrame) -> DataFrame:
    """(media_id, data): a picture for each vector (2 vec_id), and for a quarter of them an edited copy (2 vec_id + 1).

    Rows without an id or a vector have no picture and are left out; repeated rows are drawn again, no rows give no rows.
    """

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                ids, out = [], []
                for i, v in zip(batch["vec_id"][at : at + 256], batch["embedding"][at : at + 256]):
                    a = picture(v)
                    ids.append(2 * i)
                    out.append(encode_pgm(a))
                    if i % 4 == 3:
                        ids.append(2 * i + 1)
                        out.append(encode_pgm(edited(np.rint(a), i // 4 % 8)))
                yield pd.DataFrame({"media_id": ids, "data": out})

    rows = embeddings.select("vec_id", "embedding").where("vec_id is not null and embedding is not null")
    return rows.mapInPandas(drawn, "media_id long, data binary")
