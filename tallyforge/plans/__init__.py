"""All registered queries."""
from tallyforge.plans import corpus_queries, leaderboard_queries, number_queries, problem_queries  # noqa: F401
from tallyforge.plans.registry import ORACLE, QUERIES  # noqa: F401
