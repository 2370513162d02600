"""All registered queries of this subpackage."""

from labelloom.llm import queries_corpus, queries_native, queries_pairs, queries_text  # noqa: F401
from labelloom.llm.registry import ORACLES, QUERIES  # noqa: F401
