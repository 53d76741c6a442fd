"""Web-access-log analytics as Spark DataFrame operators.

Every operator is a function ``DataFrame -> DataFrame`` over one request table
(see :mod:`accesslens.schema`); nothing is collected and no Python UDF is used.
"""
