"""strandloom: a Spark-first engine for profile similarity search and interval enrichment.

Sub-packages: ``sources`` (readers and writers), ``functions`` (column
expressions and statistics), ``operators`` (DataFrame to DataFrame
operators), ``plans`` (registered queries with their SQL), ``streaming``
and the optional ``llm`` (training-data operators; nothing else imports it).
"""
