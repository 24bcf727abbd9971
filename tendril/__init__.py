"""Procurement analytics on Spark: notices, suppliers, versions, links and texts as DataFrame operators."""
