"""Queries of the driver contract, and the SQL each is checked against."""
