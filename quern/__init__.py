"""quern: Spark-first operators for scored, ordered and deduplicated page artefacts."""
