"""Grids of data-preparation and model pipelines over big tables, as Spark jobs."""
