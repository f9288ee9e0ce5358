"""Shipping-network analytics as Spark DataFrame jobs."""
