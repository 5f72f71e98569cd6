"""Stormglass: public-warning analytics written as Spark DataFrame operators."""
