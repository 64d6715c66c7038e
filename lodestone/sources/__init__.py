"""Readers that turn files and tables into the relations of ``lodestone.schemas``."""
