"""Preparing and exploring tables of any size on Spark."""
