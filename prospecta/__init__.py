"""Business-contact analytics on Spark: declarative segments, derivations, roll-ups, entity resolution, change processing."""
