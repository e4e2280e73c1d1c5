"""tabkit: profile, clean, enrich and outlier-screen periodic tabular exports on Spark."""
