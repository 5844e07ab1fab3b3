"""meterwise: model-usage metering and spend analytics on Spark.

Raw invocation logs -> canonical invocations -> usage ledger -> priced usage
-> spend, status, leaderboards, alerts, enforcement decisions and metrics.
Every operator is a ``DataFrame -> DataFrame`` function; parameters live in
:class:`meterwise.config.MeterConfig`.
"""

from meterwise.config import MeterConfig, PriceEntry

__all__ = ["MeterConfig", "PriceEntry"]
