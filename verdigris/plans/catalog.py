"""All registered queries."""

from verdigris.plans import (  # noqa: F401
    admission_queries,
    aggregate_queries,
    code_queries,
    interval_queries,
    join_queries,
    projection_queries,
    sink_queries,
    stream_queries,
    window_queries,
)
from verdigris.plans.registry import QUERIES, SQL  # noqa: F401
