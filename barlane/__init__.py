"""barlane: a Spark-first engine for evaluating minute-bar forecasts."""
