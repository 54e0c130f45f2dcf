"""lexiflow: text corpus analytics on Spark.

The main entry points, re-exported; see README.md for the design and
COVERAGE.md for the full operator list."""
from .operators.dfm import Dfm, dfm, dfm_from_long, group_documents, trim_features, weight
from .operators.filters import filter_documents
from .operators.kwic import kwic, term_positions
from .operators.search import search, search_by_group, search_kwic, search_total
from .operators.similarity import term_similarity
from .operators.stats import frequent_terms, top_features
from .operators.stem import stem_features
from .operators.tokens import clean_tokens, tokenize
from .options import TextOptions
from .plans.chain import explore
from .sources.corpus import corpus, read_corpus

__all__ = [
    "Dfm", "TextOptions", "clean_tokens", "corpus", "dfm", "dfm_from_long", "explore", "filter_documents",
    "frequent_terms", "group_documents", "kwic", "read_corpus", "search", "search_by_group", "search_kwic",
    "search_total", "stem_features", "term_positions", "term_similarity", "tokenize", "top_features",
    "trim_features", "weight",
]
