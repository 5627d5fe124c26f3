"""The live price feed on Structured Streaming."""

from .feed import params_in_effect_stream, price_direction_stream, price_feed

__all__ = ["params_in_effect_stream", "price_direction_stream", "price_feed"]
