"""staywise: churn and attrition analytics expressed as Spark DataFrame jobs.

Sub-packages
------------
sources    reading the input tables, logical-table adapters, CSV ingest,
           partitioned history stores, exports, model registry
functions  Column builders (dates, value maps, risk bands); no Python UDFs
operators  DataFrame -> DataFrame operators (labels, features, history,
           summaries, rules, metrics, model fitting/scoring, explanations)
plans      end-to-end jobs and the registered query catalog
streaming  Structured Streaming twins of the daily batch steps
"""

__version__ = "0.1.0"
