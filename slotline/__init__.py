"""Slotted sensor time series on Spark: clean, enrich, forecast, monitor and decide."""
