"""Parameters of an index."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field
from typing import Literal


@dataclass(frozen=True)
class Pruning:
    """fixed: n_postings a list. global: n_postings a list on average, at most max_fraction times as many. coi: the share alpha of a list."""

    kind: Literal["fixed", "global", "coi"] = "global"
    n_postings: int = 3500
    max_fraction: float = 1.5
    alpha: float = 0.15


@dataclass(frozen=True)
class Blocking:
    """fixed: block_size records. kmeans: a cluster for each sampled centroid; algorithm exact, inverted or approx."""

    kind: Literal["fixed", "kmeans"] = "kmeans"
    block_size: int = 10
    centroid_fraction: float = 0.1
    min_cluster_size: int = 2
    algorithm: Literal["exact", "inverted", "approx"] = "approx"
    doc_cut: int = 15
    pruning_factor: float = 0.005


@dataclass(frozen=True)
class Summarization:
    kind: Literal["fixed", "energy"] = "energy"
    n_components: int = 50
    energy: float = 0.4


@dataclass(frozen=True)
class Knn:
    """nknn neighbours a record, or those of a stored graph, its first nknn ones if nknn is above 0."""

    nknn: int = 0
    knn_path: str | None = None


@dataclass(frozen=True)
class Configuration:
    pruning: Pruning = field(default_factory=Pruning)
    blocking: Blocking = field(default_factory=Blocking)
    summarization: Summarization = field(default_factory=Summarization)
    knn: Knn = field(default_factory=Knn)
    value_type: str = "f16"

    def pruned(self, **changes) -> Configuration:
        return dataclasses.replace(self, pruning=dataclasses.replace(self.pruning, **changes))

    def blocked(self, **changes) -> Configuration:
        return dataclasses.replace(self, blocking=dataclasses.replace(self.blocking, **changes))

    def summarized(self, **changes) -> Configuration:
        return dataclasses.replace(self, summarization=dataclasses.replace(self.summarization, **changes))

    def with_knn(self, **changes) -> Configuration:
        return dataclasses.replace(self, knn=dataclasses.replace(self.knn, **changes))

    def with_value_type(self, value_type: str) -> Configuration:
        return dataclasses.replace(self, value_type=value_type)

    def to_dict(self) -> dict:
        return dataclasses.asdict(self)

    @classmethod
    def from_dict(cls, d: dict) -> Configuration:
        return cls(Pruning(**d["pruning"]), Blocking(**d["blocking"]), Summarization(**d["summarization"]), Knn(**d["knn"]), d["value_type"])
