"""Waybill analytics on Spark: change logs -> facts -> daily summaries -> reports."""
