"""Checks published statistical reports against the data tables behind them, on Spark."""
