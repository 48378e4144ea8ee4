"""Cleaning, loading, reports and chart datasets, put together from the operators."""
