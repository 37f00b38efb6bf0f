"""Photo quality, manifests, calibration and fairness as Spark jobs."""
