"""Cleaning, features, quality, warehouse, views, reports and portfolio queries."""
