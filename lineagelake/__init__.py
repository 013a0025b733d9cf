"""Clonal-barcode sequencing analytics as Spark jobs."""
