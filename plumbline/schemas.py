"""Declared schemas of the canonical tables, and conformance to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"timestamp": T.TimestampType(), "smallint": T.ShortType(), "int": T.IntegerType(), "float": T.FloatType(), "string": T.StringType(), "boolean": T.BooleanType()}


def _schema(text: str) -> T.StructType:
    """`name type, ...` without a running session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (part.split() for part in text.split(", "))])


_COMMON = "decision_time timestamp, layer_id smallint, lookback_minutes smallint, scale_role string, decision_step_minutes smallint, top_k smallint, degree_cap smallint, minimum_similarity float"
#: The columns and types of the canonical tables.
EDGES = _schema(_COMMON + ", window_start timestamp, window_end timestamp, src_id int, dst_id int, weight float, src_rank smallint, dst_rank smallint, directed boolean, lag_bars smallint, window_points smallint, vector_dimension smallint")
NODES = _schema(_COMMON + ", symbol_id int, degree smallint, strength float, core_z float, neighbor_reversal float, neighbor_signed_flow float, layer_participation float")
SNAPSHOTS = _schema(
    _COMMON + ", window_start timestamp, window_end timestamp, universe_count int, active_nodes int, node_coverage float, isolated_node_ratio float, edge_count int, degree_cap_saturation float, mean_degree float, mean_strength float, "
    "window_points smallint, vector_dimension smallint, lsh_bits smallint, used_columns string, transform string, weight_p50 float, weight_p75 float, weight_p90 float, weight_p95 float, weight_p99 float, top_1pct_mean_weight float, tail_mass_95 float"
)
TABLES = {"edges": EDGES, "node_features": NODES, "snapshots": SNAPSHOTS}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df in the schema's order and types; absent columns are null, undeclared ones raise ValueError."""
    extra = set(df.columns) - set(schema.names)
    if extra:
        raise ValueError(f"undeclared columns: {sorted(extra)}")
    return df.select(*((F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema))
