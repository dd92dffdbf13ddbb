"""tidemark: advertising-performance analytics and range forecasting on PySpark.

Everything is a lazy DataFrame plan: platform files become one fact table, the
fact table becomes gap-free daily series at four levels, and summaries,
anomalies, forecasts, budget simulations and validations are window and
aggregate expressions over those series.
"""

__version__ = "0.1.0"
