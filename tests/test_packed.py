"""Packed files written from all tasks, and filling of empty buckets over the bit cube."""

import os

import numpy as np
import pytest
from helpers import encode_plain, part_of, prefix_xor
from pyspark.sql import functions as F

from bagfold.config import EncoderConfig, Encoding, FillTarget, Projection
from bagfold.functions import randmat
from bagfold.operators import encode as enc
from bagfold.sources import arrays, tokens


def bags_of(draw, sizes, width=4):
    return [draw.normal(size=(n, width)).astype(np.float32) for n in sizes]


def test_saved_bags_are_read_back(spark, tmp_path):
    draw = np.random.default_rng(1)
    bags = bags_of(draw, [3, 0, 5, 1, 2, 0, 7] * 30)
    ids = draw.permutation(len(bags)).tolist()
    frame = tokens.from_arrays(spark, list(zip(ids, bags, strict=True))).withColumn("range", F.lit("clash")).repartition(7)
    place = arrays.save_packed(frame, f"{tmp_path}/deep/points.npy", f"{tmp_path}/deep/offsets.npy", 4)
    by_id = dict(zip(ids, bags, strict=True))
    want = [by_id[i] for i in sorted(by_id)]
    assert (np.load(tmp_path / "deep" / "points.npy") == np.concatenate(want)).all()
    off = np.load(tmp_path / "deep" / "offsets.npy")
    assert off.dtype == np.int32 and off.tolist() == np.cumsum([0, *map(len, want)]).tolist()
    assert {r.id: r.place for r in place.collect()} == {i: n for n, i in enumerate(sorted(by_id))}
    back = {r.id: r.vecs for r in arrays.load_packed(spark, f"{tmp_path}/deep/points.npy", f"{tmp_path}/deep/offsets.npy", 4).collect()}
    assert back == {n: b.tolist() for n, b in enumerate(want)}


def test_an_aborted_task_leaves_the_old_files(spark, tmp_path):
    draw = np.random.default_rng(2)
    paths = f"{tmp_path}/points.npy", f"{tmp_path}/offsets.npy"
    arrays.save_packed(tokens.from_arrays(spark, list(enumerate(bags_of(draw, [2, 3])))), *paths, 4)
    before = [open(p, "rb").read() for p in paths]
    broken = spark.createDataFrame([(0, [[1.0] * 4]), (1, [[1.0] * 3])], "id long, vecs array<array<float>>")
    with pytest.raises(Exception, match="4 numbers"):
        arrays.save_packed(broken, *paths, 4)
    assert [open(p, "rb").read() for p in paths] == before and sorted(os.listdir(tmp_path)) == ["offsets.npy", "points.npy"]


def test_null_repeated_and_no_bags(spark, tmp_path):
    paths = f"{tmp_path}/points.npy", f"{tmp_path}/offsets.npy"
    frame = spark.createDataFrame([("b", None), (None, [[1.0, 2.0]]), ("a", [[3.0, 4.0]]), ("a", [[3.0, 4.0]])], "id string, vecs array<array<double>>")
    place = arrays.save_packed(frame, *paths, 2)
    assert np.load(paths[0]).tolist() == [[1, 2], [3, 4], [3, 4]] and np.load(paths[1]).tolist() == [0, 1, 2, 3, 3]
    assert sorted((r.place, r.id) for r in place.collect()) == [(0, None), (1, "a"), (2, "a"), (3, "b")]
    arrays.save_packed(frame.limit(0), *paths, 2)
    assert np.load(paths[0]).shape == (0, 2) and np.load(paths[1]).tolist() == [0]
    assert arrays.load_packed(spark, *paths, 2).count() == 0


def test_offsets_type():
    assert arrays.offsets_type(2**31 - 1) == np.int32 and arrays.offsets_type(2**31) == np.int64


@pytest.mark.parametrize("target", list(FillTarget))
@pytest.mark.parametrize("bits", [0, 1, 4])
def test_fill_equals_plain(spark, bits, target):
    draw = np.random.default_rng(3)
    config = EncoderConfig(6, 2, bits, 9, Encoding.AVERAGE, Projection.IDENTITY, None, True, target)
    bags = [*bags_of(draw, [1, 2, 0, 5, 40], 6), np.repeat(bags_of(draw, [2], 6)[0], 3, 0)]
    frame = tokens.from_arrays(spark, list(enumerate(bags)))
    want = {i: encode_plain(b, config, lambda r: randmat.hyperplanes(config, r), lambda r: randmat.projection_matrix(config, r), range(2), True, True, target is FillTarget.INVERSE)[0] for i, b in enumerate(bags)}
    for r in enc.encode(frame, config).collect():
        assert np.allclose(r.fde, want[r.id].ravel())
    long = enc.encode_tokens(tokens.explode_bags(frame), config)
    got = {(r.id, r.rep, r.part, r.i): r.value for r in long.collect()}
    for i, dense in want.items():
        for at in np.ndindex(dense.shape):
            assert got.get((i, *at), 0.0) == pytest.approx(dense[at], abs=1e-6)


def test_fill_of_a_very_large_bag(spark):
    """100 000 vectors and 256 buckets, most of them empty."""
    draw = np.random.default_rng(4)
    config = EncoderConfig(6, 1, 8, 9, Encoding.AVERAGE, Projection.IDENTITY, None, True)
    bag = np.repeat(bags_of(draw, [9], 6)[0], 11_112, 0)[:100_000] * (1 + draw.integers(0, 4, 100_000)[:, None]).astype(np.float32)
    wide, planes = bag.astype(float), randmat.hyperplanes(config, 0).astype(float)
    hot = (wide @ planes > 0).astype(int)
    code, first = np.unique(hot @ (1 << np.arange(7, -1, -1)), return_index=True)
    label = lambda v: [int(x) for x in f"{v:08b}"]
    part = np.array([part_of(label(int(c))) for c in hot @ (1 << np.arange(7, -1, -1))])
    want = np.zeros((256, 6))
    for p in range(256):
        if (part == p).any():
            want[p] = wide[part == p].mean(0)
        else:
            aim = label(prefix_xor(p))
            want[p] = wide[min(zip(code.tolist(), first.tolist(), strict=True), key=lambda x: (sum(a != b for a, b in zip(label(x[0]), aim, strict=True)), x[1]))[1]]
    frame = tokens.from_arrays(spark, [(5, bag)])
    row = enc.encode(frame, config).first()
    assert np.allclose(np.reshape(row.fde, want.shape), want, atol=1e-4) and sum(n == 0 for n in row.sizes) > 200
    got = np.zeros_like(want)
    for r in enc.filled(tokens.explode_bags(frame), config).collect():
        got[r.part, r.i] = r.value
    empty = np.array(row.sizes) == 0
    assert np.allclose(got[empty], want[empty], atol=1e-5) and not got[~empty].any()
