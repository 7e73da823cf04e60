"""Tensor files made by hand in the published form; pickles that ask for anything else are refused."""

import io
import os
import pickle
import sys
import types
import zipfile

import numpy as np
import pytest

from bagfold.sources import tensors


class Tensor:
    def __init__(self, array, offset=0, size=None, stride=None):
        self.array, self.offset = array, offset
        self.size = size or array.shape
        self.stride = stride or tuple(s // array.itemsize for s in array.strides)


@pytest.fixture()
def write(monkeypatch, tmp_path):
    """Writes objects with tensors as such a file; stand-ins have the names that the pickle refers to."""
    torch, utils = types.ModuleType("torch"), types.ModuleType("torch._utils")
    for name in [*tensors.STORAGES, "LongStorage"]:
        setattr(torch, name, type(name, (), {"__module__": "torch"}))

    def _rebuild_tensor_v2(*_):
        raise AssertionError

    _rebuild_tensor_v2.__module__, _rebuild_tensor_v2.__qualname__ = "torch._utils", "_rebuild_tensor_v2"
    utils._rebuild_tensor_v2, torch._utils = _rebuild_tensor_v2, utils
    monkeypatch.setitem(sys.modules, "torch", torch)
    monkeypatch.setitem(sys.modules, "torch._utils", utils)

    def save(name, value, kind="FloatStorage", compress=zipfile.ZIP_STORED):
        raws = []

        class Pickler(pickle.Pickler):
            def persistent_id(self, x):
                if isinstance(x, np.ndarray):
                    raws.append(x.tobytes())
                    return ("storage", getattr(torch, kind), str(len(raws) - 1), "cpu", x.size)
                return None

            def reducer_override(self, x):
                if isinstance(x, Tensor):
                    return _rebuild_tensor_v2, (x.array, x.offset, tuple(x.size), tuple(x.stride), False, __import__("collections").OrderedDict())
                return NotImplemented

        out = io.BytesIO()
        Pickler(out, 2).dump(value)
        path = f"{tmp_path}/{name}"
        with zipfile.ZipFile(path, "w", compress) as z:
            z.writestr("archive/data.pkl", out.getvalue())
            z.writestr("archive/byteorder", "little")
            for i, raw in enumerate(raws):
                z.writestr(f"archive/data/{i}", raw)
        return path

    return save


def test_ragged_lists_and_matrices(spark, write, monkeypatch):
    monkeypatch.setattr(tensors, "RANGE_NUMBERS", 12)
    draw = np.random.default_rng(1)
    bags = [draw.normal(size=(n, 4)).astype(np.float32) for n in (3, 0, 25, 1)]
    path = write("bags.pt", [Tensor(b) for b in bags])
    assert {r.id: r.vecs for r in tensors.load_bags(spark, path, 4).collect()} == {i: b.tolist() for i, b in enumerate(bags)}
    whole = draw.normal(size=(31, 5)).astype(np.float32)
    rows = lambda p: {r.id: r.sv for r in tensors.load_matrix(spark, p).collect()}
    assert rows(write("one.pt", Tensor(whole))) == dict(enumerate(whole.tolist()))
    # a view of part of a storage, and a transposed one
    assert rows(write("part.pt", Tensor(whole, 10, (4, 5), (5, 1)))) == dict(enumerate(whole[2:6].tolist()))
    assert rows(write("turned.pt", Tensor(whole, 0, (5, 31), (1, 5)))) == dict(enumerate(whole.T.tolist()))


@pytest.mark.parametrize(("kind", "dtype"), [("DoubleStorage", "<f8"), ("HalfStorage", "<f2")])
def test_kinds_of_numbers(spark, write, kind, dtype):
    x = np.arange(12).reshape(3, 4).astype(dtype) / 4
    assert [r.sv for r in tensors.load_matrix(spark, write("x.pt", Tensor(x), kind)).orderBy("id").collect()] == x.tolist()


def test_upper_halves(spark, write):
    x = np.array([[1.0, -2.5], [0.15625, 3e8]], np.float32)
    half = (x.view(np.uint32) >> 16).astype("<u2")
    got = np.array([r.sv for r in tensors.load_matrix(spark, write("x.pt", Tensor(half), "BFloat16Storage")).orderBy("id").collect()])
    assert np.allclose(got, x, rtol=1e-2) and got[0].tolist() == [1.0, -2.5]


class Hostile:
    def __reduce__(self):
        return os.system, ("touch /tmp/hostile-tensor-file",)


def test_hostile_and_broken_files_are_refused(spark, write, tmp_path):
    x = np.ones((2, 3), np.float32)
    for name, value in (("run.pt", [Tensor(x), Hostile()]), ("eval.pt", [eval])):
        with pytest.raises(pickle.UnpicklingError):
            tensors.tensors_of(write(name, value))
    assert not os.path.exists("/tmp/hostile-tensor-file")
    with pytest.raises(pickle.UnpicklingError):
        tensors.tensors_of(write("long.pt", Tensor(x), "LongStorage"))
    with pytest.raises(ValueError, match="something else"):
        tensors.tensors_of(write("dict.pt", {"a": 1}))
    with pytest.raises(ValueError, match="compressed"):
        tensors.tensors_of(write("packed.pt", Tensor(x), compress=zipfile.ZIP_DEFLATED))
    for name, value in (("beyond.pt", Tensor(x, 1, (2, 3), (3, 1))), ("flat.pt", Tensor(x, 0, (6,), (1,))), ("list.pt", [Tensor(x)])):
        with pytest.raises(Exception, match="beyond|dimensions|list"):
            tensors.load_matrix(spark, write(name, value)).collect()
    with zipfile.ZipFile(tmp_path / "none.pt", "w") as z:
        z.writestr("other", "x")
    with pytest.raises(ValueError, match="isn't a tensor file"):
        tensors.tensors_of(f"{tmp_path}/none.pt")


def test_converted_where_missing(spark, write, tmp_path):
    draw = np.random.default_rng(2)
    bags = [draw.normal(size=(n, 3)).astype(np.float32) for n in (2, 4)]
    paths = f"{tmp_path}/p.npy", f"{tmp_path}/o.npy"
    with pytest.raises(FileNotFoundError):
        tensors.ensure_packed(spark, *paths, f"{tmp_path}/nothing.pt", 3)
    source = write("bags.pt", [Tensor(b) for b in bags])
    want = {i: b.tolist() for i, b in enumerate(bags)}
    for _ in range(2):  # made, then read
        assert {r.id: r.vecs for r in tensors.ensure_packed(spark, *paths, source, 3).collect()} == want
    os.remove(source)
    assert tensors.ensure_packed(spark, *paths, source, 3).count() == 2
