"""oppsift: finds actionable opportunities in noisy multi-source text, on Spark."""
