"""Claim-verification analytics as Spark DataFrame transformations."""
