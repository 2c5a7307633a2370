import numpy as np
from pyspark.sql import functions as F

from millrace.functions import numbers
from millrace.operators import images


def picture(seed, w=50, h=40):
    r = np.random.default_rng(seed)
    y, x = np.mgrid[:h, :w]
    base = np.stack([127 + 100 * np.sin(x / (3 + seed) + k) * np.cos(y / 7) for k in range(3)], 2)
    return np.clip(base + r.normal(0, 3, base.shape), 0, 255).astype(np.uint8), w, h


def test_features_have_the_right_parts():
    f = images.features(picture(1)[0].ravel(), 50, 40)
    assert f.shape == (1813,)
    assert abs(f[1764:1812].sum() - 3) < 1e-5
    assert abs(f[1812] - np.log(50 / 40)) < 1e-6
    assert 0 <= f[:1764].min() <= f[:1764].max() <= 1


def test_hash_is_near_for_like_and_far_for_other_pictures():
    a, w, h = picture(1)
    brighter = np.clip(a.astype(int) + 8, 0, 255).astype(np.uint8)
    big = np.repeat(np.repeat(a, 2, 0), 2, 1)
    x = images.perceptual_hash(a.ravel(), w, h)
    far = images.perceptual_hash(picture(4)[0].ravel(), 50, 40)
    bits = lambda p, q: ((p ^ q) & (2**64 - 1)).bit_count()
    assert bits(x, images.perceptual_hash(brighter.ravel(), w, h)) <= 6
    assert bits(x, images.perceptual_hash(big.ravel(), 2 * w, 2 * h)) <= 6
    assert bits(x, far) > 12
    assert x & 1 == 0


def test_frames_with_nulls_and_wrong_sizes(spark):
    a, w, h = picture(2)
    rows = [(1, bytearray(a.tobytes()), w, h), (2, None, 3, 3), (3, bytearray(b"abc"), 5, 5), (4, bytearray(b""), 0, 0)]
    df = spark.createDataFrame(rows, "id long, p binary, w int, h int")
    got = {r["id"]: (r["f"], r["x"]) for r in df.select("id", images.image_features("p", "w", "h").alias("f"), images.image_hash("p", "w", "h").alias("x")).collect()}
    assert len(got[1][0]) == 1813
    assert got[1][1] == images.perceptual_hash(a.ravel(), w, h)
    assert got[2] == got[3] == got[4] == (None, None)


def test_crop_and_hex(spark):
    a, w, h = picture(3)
    assert images.crop(a.tobytes(), w, 2, 3, 7, 9) == a[3:9, 2:7].tobytes()
    df = spark.createDataFrame([("ffffffffffffffff",), ("0f",), ("xyz",), (None,)], "t string")
    assert [r[0] for r in df.select(numbers.hash_from_hex(F.col("t"))).collect()] == [-1, 15, None, None]
    assert spark.range(1).select(numbers.hamming(F.lit(-1), F.lit(0))).first()[0] == 64
