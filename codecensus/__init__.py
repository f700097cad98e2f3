"""codecensus: a Spark-native census of source-code repositories.

Input is a ``files`` table (one row per file of a repository snapshot); every
operator is a DataFrame -> DataFrame or Column -> Column function that runs the
same job for all repositories and snapshots at once.
"""

__version__ = "0.1.0"
