"""All queries of this subpackage and their checking SQL."""

from jobflow.llm import (  # noqa: F401 (each module registers its query)
    alignment, ann, decontamination, html_text, infilling, lm, mixing, near_vectors, ngram_join, passages, pieces, quality, warc,
)
from jobflow.llm.registry import ORACLES, QUERIES


def load_all():
    return QUERIES, ORACLES
