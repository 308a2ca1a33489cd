"""Spindrift: catalog search, purchase personalisation and corpus preparation on Spark.

Operators are functions from DataFrames to DataFrames.  ``functions`` holds
Column builders, ``operators`` the relational operators, ``sources`` readers and
writers, ``plans`` end-to-end compositions, ``streaming`` the stateful operators
and ``llm`` the corpus operators (nothing outside ``llm`` imports that one).
"""
