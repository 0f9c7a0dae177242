"""A GoogleSQL analytics engine on Apache Spark.

``plans`` turns GoogleSQL text into Spark SQL text, ``functions`` holds the function
table, ``sources`` the catalog and external readers, ``operators`` the relational and
data-changing operators that Spark lacks, ``streaming`` the windowed streams.
"""

from .session import create_session

__all__ = ["create_session"]
