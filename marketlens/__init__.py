"""marketlens: daily market bars, company news and filings on Spark DataFrames."""

from marketlens.session import get_session

__all__ = ["get_session"]
__version__ = "0.1.0"
