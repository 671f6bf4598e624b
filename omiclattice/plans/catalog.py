"""All registered queries."""

from omiclattice.plans import evidence_queries, extra_queries, matrix_queries, network_queries, sequence_queries, spectra_queries, text_queries  # noqa: F401
from omiclattice.plans.registry import ORACLES, QUERIES  # noqa: F401
