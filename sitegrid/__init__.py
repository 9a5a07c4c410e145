"""sitegrid: auditing large registries of located entities with PySpark."""

__version__ = "0.1.0"
