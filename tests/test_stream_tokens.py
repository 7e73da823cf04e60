"""A stream of single vectors gives the encodings of the whole bags, however they arrive."""

import numpy as np
import pytest

from bagfold.config import EncoderConfig, Encoding, Projection
from bagfold.operators import encode as enc
from bagfold.sources import tokens as tk

stream = pytest.importorskip("bagfold.streaming.tokens")

CONFIG = EncoderConfig(6, 3, 3, 5, Encoding.AVERAGE, Projection.AMS, 4)


def arrivals(draw, bags):
    """Every vector once at least, a third of them twice, some with another vector the second time, in any order."""
    rows = [(i, p, v.tolist()) for i, b in enumerate(bags) for p, v in enumerate(b)]
    more = [(i, p, (v if p % 2 else np.zeros(6)).tolist() if hasattr(v, "tolist") else v) for i, p, v in [(i, p, np.array(v)) for i, p, v in rows[::3]]]
    order = draw.permutation(len(rows))
    return [rows[j] for j in order], more


def run(spark, tmp_path, waves, config, **more):
    """Encodings after each wave."""
    out = []
    stream.use_rocksdb(spark)
    schema = "id long, pos long, vec array<float>"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/in")

    def keep(frame, _):
        out.append({r.id: (r.vec, r.vectors) for r in frame.collect()})

    for wave in waves:  # a query that is stopped and goes on from its checkpoint
        spark.createDataFrame(wave, schema).repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
        rows = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        query = stream.encoded_tokens(rows, config, **more).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").foreachBatch(keep).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        if query.exception():
            raise query.exception()
    spark.conf.unset(stream.PROVIDER)
    return out


def test_stream_equals_batch(spark, tmp_path):
    draw = np.random.default_rng(7)
    bags = [draw.normal(size=(n, 6)).astype(np.float32) for n in (1, 5, 17, 2, 40)]
    first, again = arrivals(draw, bags)
    waves = [first[:20], first[20:] + [(None, 0, [0.0] * 6), (0, None, [0.0] * 6), (0, 9, None)], again]
    got = run(spark, tmp_path, waves, CONFIG)
    last = {}
    for wave in got:
        last.update(wave)
    whole = {r.id: r.fde for r in enc.encode(tk.from_arrays(spark, list(enumerate(bags))), CONFIG).collect()}
    assert set(last) == set(whole)
    for i, (vec, vectors) in last.items():
        assert vectors == len(bags[i]) and np.allclose(vec, whole[i], atol=1e-9)
    assert sum(len(w) for w in got[2:]) == 0  # repetitions change nothing
    # and each state on the way is that of what had arrived
    some = {}
    for i, p, v in waves[0]:
        some.setdefault(i, []).append((p, v))
    partly = {r.id: r.fde for r in enc.encode(tk.from_arrays(spark, [(i, np.array([v for _, v in sorted(x)], np.float32)) for i, x in some.items()]), CONFIG).collect()}
    for i, vec in partly.items():
        assert np.allclose(got[0][i][0], vec, atol=1e-9)


def test_fill_and_widths_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        stream.encoded_tokens(spark.createDataFrame([], "id long, pos long, vec array<float>"), EncoderConfig(6, 1, 2, 1, Encoding.AVERAGE, Projection.IDENTITY, None, True))
    with pytest.raises(Exception, match="6 numbers"):
        run(spark, tmp_path, [[(1, 0, [1.0])]], CONFIG)
