"""Imports every query module so that the registry is complete."""

from coheral.plans import (arena_queries, conversation_queries, essay_queries, external_queries, judge_queries,  # noqa: F401
                           metric_queries, rating_queries, release_queries, topic_queries)
from coheral.plans.registry import QUERIES  # noqa: F401
