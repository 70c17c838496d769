"""Imports every plan module so that its queries are registered."""

from tabularium.plans import activity, analysis, business, cleaning, models, profiling, storage  # noqa: F401
from tabularium.plans.registry import QUERIES, SQL  # noqa: F401
