"""Composed jobs: analysis, clip planning and species lists."""
