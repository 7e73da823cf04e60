"""Run a retrieval plan over a collection: ``spark-submit -m bagfold.cli --dataset fiqa ...`` or ``python -m bagfold.cli``.

Folders come from the arguments, else from $BAGFOLD_COLLECTIONS and $BAGFOLD_VECTORS, else from ``collections`` and ``vectors``.
"""

from __future__ import annotations

import argparse
import json
import os
import resource
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from .config import dataset_settings
from .operators import graph, metrics
from .plans import retrieval
from .sources import collections as source


@contextmanager
def step(name: str, taken: dict[str, float]) -> Iterator[None]:
    """Prints how long a step took and how large the driver's Python has become."""
    began = time.time()
    yield
    taken[name] = time.time() - began
    print(f"{name}: {taken[name]:.2f} s, {resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024:.0f} MB")


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    parse = argparse.ArgumentParser(description=__doc__)
    parse.add_argument("--dataset", required=True)
    parse.add_argument("--collections")
    parse.add_argument("--vectors")
    parse.add_argument("--mv-encoder", default="mv")
    parse.add_argument("--sv-encoder", default="sv")
    parse.add_argument("--top-k", type=int, default=10)
    parse.add_argument("--sampling-rate", type=float, default=0.5)
    parse.add_argument("--keep-dimensions", type=int, default=200)
    parse.add_argument("--projection-dimension", type=int, default=16)
    parse.add_argument("--choose-rate", type=float)
    parse.add_argument("--repetitions", type=int)
    parse.add_argument("--bits", type=int)
    parse.add_argument("--cells", type=int, help="search approximately, with so many cells")
    parse.add_argument("--probes", type=int, help="cells that a query searches; five in six if not given")
    parse.add_argument("--index", help="search approximately along the graph saved here; built first if there is none")
    parse.add_argument("--beam", type=int, default=graph.BEAM)
    parse.add_argument("--hybrid", action=argparse.BooleanOptionalAction, default=True)
    parse.add_argument("--train-fusion", action="store_true")
    parse.add_argument("--fusion-epochs", type=int, default=20)
    parse.add_argument("--fusion-rate", type=float, default=0.1)
    parse.add_argument("--fusion-negatives", type=int, default=64)
    parse.add_argument("--seed", type=int, default=42)
    return parse.parse_args(given)


def main(given: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    args = arguments(given)
    spark = spark or SparkSession.builder.appName("bagfold").getOrCreate()
    folder = source.resolve(args.dataset, args.collections, "BAGFOLD_COLLECTIONS", "collections")
    root = args.vectors or os.environ.get("BAGFOLD_VECTORS") or "vectors"
    settings = dataset_settings(args.dataset, projection_dimension=args.projection_dimension, keep_dimensions=args.keep_dimensions, sampling_rate=args.sampling_rate, top_k=args.top_k, sample_seed=args.seed)
    changes = {k: getattr(args, k) for k in ("choose_rate", "repetitions", "bits") if getattr(args, k) is not None}
    settings = type(settings)(**{**settings.__dict__, **changes})
    split, taken = source.default_split(args.dataset), {}
    qrels = source.load_qrels(spark, folder, split)
    corpus, d_sv, queries, q_sv = source.load_embeddings(spark, root, args.dataset, args.mv_encoder, args.sv_encoder, split)
    dimension = len(corpus.selectExpr("vecs[0] AS v").filter("v is not null").first().v)
    with step("offline", taken):
        built = retrieval.offline(corpus, dimension, settings, args.hybrid)
    fused = None
    if args.train_fusion and args.hybrid:
        with step("fusion", taken):
            _, _, t_queries, t_sv = source.load_embeddings(spark, root, args.dataset, args.mv_encoder, args.sv_encoder, "train")
            fused, _ = retrieval.fit_fusion(built, t_queries, source.load_qrels(spark, folder, "train"), d_sv, t_sv, args.top_k, args.fusion_negatives, args.fusion_epochs, args.fusion_rate, args.seed)
    with step("online", taken):
        run = retrieval.online(built, queries, args.top_k, d_sv, q_sv, fused, args.cells, args.probes, args.index, args.beam)
        rows = metrics.evaluate(run, qrels, [10]).collect()
    out = {"metrics": {f"{r.metric}@{r.k}": r.value for r in rows}, "seconds": taken, "queries_per_second": queries.count() / taken["online"]}
    print(json.dumps(out))
    return out


if __name__ == "__main__":
    main()
