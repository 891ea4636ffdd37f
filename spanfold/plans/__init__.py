"""From a query's text to what Spark runs: language, resolution of terms, selection, evaluation."""
