"""A Spark library for company filings, news, prices and text corpora."""
