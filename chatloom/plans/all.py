"""All queries, by importing the modules that register them."""

from chatloom.plans import calls, corpora, corpus, evaluation, scores, stores, tokens  # noqa: F401
from chatloom.plans.registry import QUERIES, SQL  # noqa: F401
