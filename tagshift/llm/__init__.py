"""Training-data operators over documents, pages and embeddings; nothing else in the library imports this package."""

from tagshift.llm import alignment, decontamination, html_text, line_dedup, ngram_join, packing, quality_knn, quality_rules, sharding, token_counts, toxicity, url_filter, whitening  # noqa: F401
from tagshift.llm.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
