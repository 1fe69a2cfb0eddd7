"""quillon: corpus search, evidence governance and change jobs as Spark DataFrame programs."""
