"""All queries outside the llm subpackage, by name, with the SQL that says the same."""

from brindle.plans import data, logs, measures, retrieval, texts, training  # noqa: F401  (they register)
from brindle.plans.registry import ORACLE, QUERIES  # noqa: F401
