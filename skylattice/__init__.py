"""Sky-map aperture, matching and corpus analytics expressed as Spark DataFrame plans."""
