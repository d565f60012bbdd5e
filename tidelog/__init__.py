"""Keyed, versioned data on Spark: a changelog of puts and deletes, and all that follows from it."""
