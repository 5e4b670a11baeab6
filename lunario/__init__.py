"""lunario: raw, irregular event tables -> regular time series -> features -> models, on Spark.

Sub-packages: ``operators`` (table to table), ``functions`` (column and array functions), ``sources``
(readers and writers), ``plans`` (step chains and configs), ``streaming``, ``queries`` (the registered
queries) and ``llm`` (corpus operators; optional, nothing else imports it).
"""

__version__ = "0.1.0"
