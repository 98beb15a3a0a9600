"""Election, calendar and public-statistics operators on Spark DataFrames."""

from civicspark.session import get_session

__all__ = ["get_session"]
