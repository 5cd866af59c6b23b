"""tierscope: subscription analytics over a customer-by-month table, on Spark.

Every public operator takes a DataFrame with the schema in
``tierscope.sources.schema.BASE_SCHEMA`` and returns a lazy DataFrame.
Nothing in the library collects data to the driver.
"""

from tierscope.session import get_or_create_session, scratch_dir

__all__ = ["get_or_create_session", "scratch_dir"]
