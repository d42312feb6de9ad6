"""allelo: population-genetic data preparation and posterior analytics as Spark DataFrame transforms."""
