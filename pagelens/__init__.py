"""pagelens: page analytics on Spark.

Raw HTML pages are cleaned with native column expressions, parsed once into a
relational node table, and every extraction (selectors, main content,
markdown, structured profiles, reports) is expressed as DataFrame joins,
windows and aggregations over that table.
"""

from pagelens.session import get_spark, checkpoint_dir, read_table

__all__ = ["get_spark", "checkpoint_dir", "read_table"]
