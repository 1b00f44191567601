"""Windows, features, returns, metrics, strategies, submissions and forecasts."""
