"""barlab: bar analytics (screening, signals, backtests) as Spark jobs."""
