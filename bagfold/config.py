"""Settings of the encoder and of the retrieval plans."""

from __future__ import annotations

from dataclasses import dataclass, replace
from enum import Enum


class Encoding(Enum):
    SUM = "sum"
    AVERAGE = "average"


class Projection(Enum):
    IDENTITY = "identity"
    AMS = "ams"


class FillTarget(Enum):
    """What an empty bucket's number is compared with: its prefix XOR (default), or the bits that truly hash to it."""

    PREFIX_XOR = "prefix_xor"
    INVERSE = "inverse"


@dataclass(frozen=True)
class EncoderConfig:
    """How a bag of vectors becomes one vector: ``repetitions`` times 2**``bits`` buckets of ``width`` numbers each."""

    dimension: int = 128
    repetitions: int = 10
    bits: int = 6
    seed: int = 42
    encoding: Encoding = Encoding.SUM
    projection: Projection = Projection.IDENTITY
    projection_dimension: int | None = None
    fill_empty: bool = False
    fill_target: FillTarget = FillTarget.PREFIX_XOR
    final_dimension: int | None = None

    def __post_init__(self) -> None:
        if self.dimension < 1 or self.repetitions < 1:
            raise ValueError("dimension and repetitions must be positive")
        if not 0 <= self.bits < 32:
            raise ValueError("bits must be from 0 to 31")
        if self.projection is Projection.AMS and (self.projection_dimension or 0) < 1:
            raise ValueError("an AMS projection needs a positive projection_dimension")
        if self.final_dimension is not None and self.final_dimension < 1:
            raise ValueError("final_dimension must be positive")

    @property
    def buckets(self) -> int:
        return 1 << self.bits

    @property
    def width(self) -> int:
        return self.projection_dimension if self.projection is Projection.AMS else self.dimension  # type: ignore[return-value]

    @property
    def block(self) -> int:
        """Numbers of one repetition."""
        return self.buckets * self.width

    def for_queries(self) -> EncoderConfig:
        """Queries are summed and never filled."""
        if self.fill_empty:
            raise ValueError("queries can't fill empty buckets")
        return replace(self, encoding=Encoding.SUM)

    def for_documents(self, fill: bool = True) -> EncoderConfig:
        return replace(self, encoding=Encoding.AVERAGE, fill_empty=fill)

    def chosen(self, reps: list[int] | None) -> list[int]:
        """The repetitions to use, in the given order."""
        if reps is None:
            return list(range(self.repetitions))
        if not len(reps):
            raise ValueError("no repetition is chosen")
        if min(reps) < 0 or max(reps) >= self.repetitions:
            raise ValueError("a chosen repetition is out of range")
        return [int(r) for r in reps]


@dataclass(frozen=True)
class RetrievalSettings:
    """Share of repetitions kept, repetitions, bits; and what the plans need besides."""

    choose_rate: float
    repetitions: int = 160
    bits: int = 5
    projection_dimension: int = 16
    keep_dimensions: int = 200
    sampling_rate: float = 0.5
    top_k: int = 10
    encoder_seed: int = 42
    sample_seed: int = 42


#: Fixed values by dataset: (choose_rate, repetitions, bits).
DATASETS = {"fiqa": (0.8, 20, 6), "scidocs": (0.1, 300, 5)}
OTHER_DATASETS = (0.1, 160, 5)


def dataset_settings(name: str, **more) -> RetrievalSettings:
    rate, reps, bits = DATASETS.get(name, OTHER_DATASETS)
    return RetrievalSettings(choose_rate=rate, repetitions=reps, bits=bits, **more)
