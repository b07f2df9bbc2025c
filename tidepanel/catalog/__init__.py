from tidepanel.catalog import feature_queries, trading_queries, model_queries, fit_queries  # noqa: F401, I001
from tidepanel.catalog.base import REGISTRY

__all__ = ["REGISTRY"]
