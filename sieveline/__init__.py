"""Virtual-screening analytics as composable PySpark DataFrame operators."""

from .params import DEFAULTS, ScreenParams

__all__ = ["DEFAULTS", "ScreenParams"]
