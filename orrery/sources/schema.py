"""Table schemas and settings."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import types as T

TOKENS = T.StructType([T.StructField("file_id", T.IntegerType()), T.StructField("cell_id", T.IntegerType()), T.StructField("features", T.ArrayType(T.FloatType()))])
ASSIGNMENTS = T.StructType([T.StructField(c, T.IntegerType()) for c in ("file_id", "cell_id", "label")])
MODEL = T.StructType([
    T.StructField("cluster", T.IntegerType()), T.StructField("mean", T.ArrayType(T.DoubleType())), T.StructField("basis", T.ArrayType(T.ArrayType(T.DoubleType()))),
    T.StructField("eigvals", T.ArrayType(T.DoubleType())), T.StructField("trace", T.DoubleType()), T.StructField("n", T.LongType()), T.StructField("evr", T.DoubleType()),
    T.StructField("radius", T.DoubleType()), T.StructField("reseeded", T.BooleanType()),
])
RUN = T.StructType([
    T.StructField("fingerprint", T.StringType()), T.StructField("config", T.MapType(T.StringType(), T.StringType())), T.StructField("files", T.ArrayType(T.IntegerType())), T.StructField("final_obj_per_token", T.DoubleType()),
])
HISTORY = T.StructType([T.StructField("iter", T.IntegerType()), T.StructField("obj_per_token", T.DoubleType()), T.StructField("frac_changed", T.DoubleType()), T.StructField("size_min", T.LongType()), T.StructField("size_max", T.LongType()), T.StructField("size_median", T.LongType())])
MANIFEST = T.StructType([T.StructField("fingerprint", T.StringType()), T.StructField("num_files", T.IntegerType()), T.StructField("tokens_per_file", T.IntegerType()), T.StructField("seed", T.IntegerType()), T.StructField("src", T.StringType()), T.StructField("files", T.ArrayType(T.IntegerType()))])

_HELD = T.StructType([T.StructField(c, T.DoubleType()) for c in ("total", "residual", "within", "captured", "residual_frac", "modeled_frac")])
_INSIDE = T.StructType([T.StructField(c, T.DoubleType()) for c in ("total", "residual", "residual_frac", "final_obj_per_token")])
#: The nested document of a hold-out evaluation; all but the counts and fractions are per token.
HOLDOUT = T.StructType([T.StructField("num_holdout_files", T.IntegerType()), T.StructField("num_holdout_tokens", T.LongType()), T.StructField("holdout", _HELD), T.StructField("in_sample", _INSIDE)])

# Fixed values of the original data set; every function takes them as parameters.
N_FILES, N_CELLS, DIM = 13021, 12288, 2048


@dataclass(frozen=True)
class LoadConfig:
    """Settings of a load: which files of a token table, and how much of each."""

    num_files: int = 1500
    tokens_per_file: int | None = None
    seed: int = 0
    dim: int = DIM
    n_cells: int | None = None
    n_files_total: int | None = None
    files_from: str | None = None
    files_per_folder: int = 1
    max_bytes: int | None = None


@dataclass(frozen=True)
class AnalyzeConfig:
    """Settings of the clustering report of a run folder."""

    dir: str
    out: str | None = None
    top_pairs: int = 12


@dataclass(frozen=True)
class TemporalConfig:
    """Settings of the report by months; coastlines name a GeoJSON file."""

    dir: str
    out: str | None = None
    top_seasonal: int = 8
    coastlines: str | None = None
    heatmap: bool = True
    degrees: float = 2.0


@dataclass(frozen=True)
class HoldoutConfig:
    """Settings of a hold-out evaluation; ``src`` is the run's own token table if it isn't given."""

    dir: str
    src: str | None = None
    num_files: int = 200
    seed: int = 12345
    max_bytes: int | None = None


@dataclass(frozen=True)
class FitConfig:
    """Settings of a fit; dim 0 is k-means, linear subspaces pass through the origin."""

    clusters: int = 64
    dim: int = 16
    iters: int = 25
    tol: float = 1e-3
    seed: int = 0
    linear: bool = False
    min_count: int | None = None

    def __post_init__(self):
        if self.linear and self.dim == 0:
            raise ValueError("linear subspaces of dimension 0 leave every token at the same residual")

    @property
    def least(self) -> int:
        """Tokens under which a cluster counts as tiny."""
        return self.min_count if self.min_count is not None else max(2 * self.dim, 64)

    def as_map(self) -> dict[str, str]:
        return {"method": "kmeans" if self.dim == 0 else "subspace_kmeans"} | {k: str(v) for k, v in asdict(self).items()}
