"""Spark-first analytics for property-prediction tables and the graphs behind them."""
