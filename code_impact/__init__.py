"""Code-change impact analysis over tables of repositories and pull requests, as PySpark jobs."""
