"""All queries of the training-data operators."""

from verdigris.llm import queries_search, queries_sets, queries_text  # noqa: F401
from verdigris.llm.registry import QUERIES, SQL  # noqa: F401
