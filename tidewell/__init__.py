"""tidewell: a Spark-first engine for advertising-funnel events and training-data tables."""
