"""conflictlake: a Spark-native engine that turns version-control history and
conflicted files, given as tables, into a dataset of merge conflicts with their
human resolutions.

Every operator is a ``DataFrame -> DataFrame`` function; nothing is collected to
the driver on the data path.
"""

__version__ = "0.1.0"
