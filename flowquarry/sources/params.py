"""Small fitted artifacts: feature lists, scalers, open-set parameters, thresholds."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PARAMS_DDL = ("mavs map<string,array<double>>, weibull_params map<string,array<double>>, "
               "known_classes array<int>, unknown_classes array<int>, tail_size int, "
               "alpha_rank int, distance_type string, num_known int")


@dataclass
class OpenMaxParams:
    """Class means and Weibull tails of one fitted open-set model; K x D numbers at most."""

    num_known: int
    mavs: dict[int, list[float]]
    weibull: dict[int, tuple[float, float] | None] = field(default_factory=dict)
    distance_type: str = "cosine"
    alpha_rank: int = 5
    tail_size: int = 200

    def __post_init__(self):
        if self.distance_type not in ("cosine", "euclidean"):
            raise ValueError("distance_type must be 'cosine' or 'euclidean'")
        scales = [w[1] for w in self.weibull.values() if w]
        if self.distance_type == "cosine" and any(s > 2 for s in scales):
            warnings.warn("Weibull scale above 2 with cosine distance (never above 2): "
                          "hardly any row will be rejected", stacklevel=2)

    def mav(self, k: int) -> list[float]:
        """Mean vector of a class; a class without training rows has the zero vector."""
        width = len(next(iter(self.mavs.values())))
        return self.mavs.get(k, [0.0] * width)


def read_openmax_params(spark: SparkSession, path: str) -> DataFrame:
    """JSON parameters as one row per known class; a null Weibull stays null."""
    raw = spark.read.schema(_PARAMS_DDL).option("multiLine", True).json(path)
    rows = raw.select("*", F.explode(F.sequence(F.lit(0), F.col("num_known") - 1)).alias("class"))
    key = F.col("class").cast("string")
    wb = F.try_element_at("weibull_params", key)
    return rows.select(
        "class", F.try_element_at("mavs", key).alias("mav"),
        wb[0].alias("wb_shape"), wb[1].alias("wb_loc"), wb[2].alias("wb_scale"),
        "tail_size", "alpha_rank", "distance_type", "num_known")


def load_openmax_params(params: DataFrame, **settings) -> OpenMaxParams:
    """Fitted-parameter rows (one per class) to the driver-side object."""
    rows = params.collect()
    known = {k: rows[0][k] for k in ("num_known", "alpha_rank", "tail_size", "distance_type")
             if rows and k in params.columns}
    known.update(settings)
    known.setdefault("num_known", len(rows))
    return OpenMaxParams(
        mavs={r["class"]: list(r["mav"]) for r in rows if r["mav"] is not None},
        weibull={r["class"]: (r["wb_shape"], r["wb_scale"]) if r["wb_shape"] is not None else None
                 for r in rows}, **known)


def read_feature_list(spark: SparkSession, path: str) -> DataFrame:
    """JSON array of names as (pos, feature) rows; order matters."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.from_json("value", "array<string>")).alias("pos", "feature"))


def write_scaler(scaler: DataFrame, path: str) -> None:
    """Persist fitted minima and maxima: (feature, pos, min, max)."""
    scaler.coalesce(1).write.mode("overwrite").parquet(path)


def read_scaler(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def is_complete(spark: SparkSession, path: str) -> bool:
    """A write to this folder has ended; a folder without the mark is a failed one."""
    return path_exists(spark, f"{path.rstrip('/')}/_SUCCESS")


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder, from its listing alone; none if it isn't there."""
    fs, hadoop = _located(spark, path)
    return [entry.getPath().getName() for entry in fs.listStatus(hadoop)] if fs.exists(hadoop) else []


def _located(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def touch(spark: SparkSession, path: str) -> None:
    """An empty file, made with its folders."""
    fs, hadoop = _located(spark, path)
    fs.create(hadoop, True).close()


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    fs, hadoop = _located(spark, path)
    fs.delete(hadoop, True)


def move_path(spark: SparkSession, source: str, target: str) -> bool:
    """Give ``source`` the name ``target``; false if that is taken."""
    fs, old = _located(spark, source)
    _, new = _located(spark, target)
    return not fs.exists(new) and fs.rename(old, new)


def scaler_or_fit(spark: SparkSession, path: str, fit) -> DataFrame:
    """Reuse a stored scaler, or call ``fit`` and store its table."""
    if not is_complete(spark, path):
        write_scaler(fit(), path)
    return read_scaler(spark, path)


def write_threshold(spark: SparkSession, threshold: float, path: str,
                    meta: dict[str, str] | None = None) -> None:
    """One JSON record with the threshold and optional run notes."""
    row = spark.range(1).select(
        F.lit(float(threshold)).alias("threshold"),
        *[F.lit(str(v)).alias(k) for k, v in (meta or {}).items()])
    row.coalesce(1).write.mode("overwrite").json(path)


def read_threshold(spark: SparkSession, path: str) -> float:
    return spark.read.json(path).first()["threshold"]


def names_of(features: DataFrame) -> Sequence[str]:
    """Feature list rows to an ordered Python list."""
    return [r["feature"] for r in features.orderBy("pos").collect()]
