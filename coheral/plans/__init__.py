"""Registered queries (name -> Spark job over the driver tables) and their SQL oracles."""
