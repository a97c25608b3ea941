"""Collections, points and requests of the vector engine."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from enum import Enum

POINT_SCHEMA = "id string, values array<float>, payload string, sparse struct<indices:array<bigint>, values:array<float>>"


class VexelError(Exception):
    """Base of the engine's errors."""


class CollectionExists(VexelError):
    pass


class CollectionNotFound(VexelError):
    pass


class PointNotFound(VexelError):
    pass


class InvalidRequest(VexelError, ValueError):
    pass


class Metric(str, Enum):
    COSINE = "cosine"
    EUCLIDEAN = "euclidean"
    DOT = "dot_product"

    @classmethod
    def parse(cls, name: str | Metric | None) -> Metric:
        if isinstance(name, cls):
            return name
        names = {"": cls.COSINE, "cosine": cls.COSINE, "euclidean": cls.EUCLIDEAN, "l2": cls.EUCLIDEAN, "dot": cls.DOT, "dot_product": cls.DOT}
        return names.get((name or "").lower(), cls.COSINE)


class Mode(str, Enum):
    DENSE = "dense"
    SPARSE = "sparse"
    BM25 = "bm25"
    RRF = "hybrid_rrf"
    WEIGHTED = "hybrid_weighted"

    @classmethod
    def parse(cls, name: str | Mode | None) -> Mode:
        """Aliases lexical, hybrid, weighted; an unknown name is dense."""
        if isinstance(name, cls):
            return name
        names = {m.value: m for m in cls} | {"lexical": cls.BM25, "hybrid": cls.RRF, "weighted": cls.WEIGHTED}
        return names.get((name or "").lower(), cls.DENSE)


class IndexKind(str, Enum):
    KEYWORD = "keyword"
    NUMERIC = "numeric"
    BOOL = "bool"


@dataclass(frozen=True)
class CollectionConfig:
    name: str
    dimension: int
    metric: Metric = Metric.COSINE
    m: int = 16
    ef_construction: int = 200
    ef_search: int = 64
    payload_indexes: dict[str, IndexKind] = field(default_factory=dict)
    sparse_enabled: bool = False
    bm25_text_field: str | None = None
    quantization: bool = False

    def __post_init__(self):
        object.__setattr__(self, "metric", Metric.parse(self.metric))
        object.__setattr__(self, "payload_indexes", {k: IndexKind(v) for k, v in dict(self.payload_indexes).items()})

    def validate(self) -> CollectionConfig:
        if not self.name:
            raise InvalidRequest("a collection needs a name")
        if self.dimension <= 0 or self.m < 2 or self.ef_construction < self.m or self.ef_search < 1:
            raise InvalidRequest("dimension > 0, m >= 2, ef_construction >= m and ef_search >= 1 must hold")
        return self

    def to_dict(self) -> dict:
        return asdict(self) | {"metric": self.metric.value, "payload_indexes": {k: v.value for k, v in self.payload_indexes.items()}}

    @classmethod
    def from_dict(cls, d: dict) -> CollectionConfig:
        unknown = set(d) - set(cls.__dataclass_fields__)
        if unknown:
            raise InvalidRequest(f"no such settings: {sorted(unknown)}")
        return cls(**d)


@dataclass(frozen=True)
class SearchRequest:
    vector: list[float] | None = None
    sparse: dict[int, float] | None = None
    text: str | None = None
    top_k: int = 10
    mode: Mode | str = Mode.DENSE
    filter: dict | None = None
    filter_ids: list[str] | None = None
    alpha: float | None = None
    raw_overfetch: bool = False
    filter_mode: str = "post"
    exact: bool = True
    probes: int = 8

    @property
    def k(self) -> int:
        return max(1, self.top_k)

    @property
    def weight(self) -> float:
        """None is even; others are kept in [0, 1]."""
        return 0.5 if self.alpha is None else min(1.0, max(0.0, self.alpha))
