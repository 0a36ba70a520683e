"""Analytics operators for media curation and telemetry, as Spark DataFrame plans."""
