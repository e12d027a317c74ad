"""verdant: company sustainability (ESG) analytics on Spark.

Every operator takes and returns DataFrames (or Columns) and answers for all
companies at once; the one-company view is a filter on the result.
"""

from verdant.session import get_session, checkpoint_root

__all__ = ["get_session", "checkpoint_root"]
