"""All registered queries of the subpackage."""

from ladderspark.llm import bpe, embedding_dedup, exact_dedup, fill_middle, fingerprints, importance, jaccard_join, licenses, lm_scoring, mixing, quality, secret_scan, url_filter  # noqa: F401
from ladderspark.llm.common import QUERIES, SQL


def load():
    return dict(QUERIES), dict(SQL)
