"""tessera: condition tables -> predictions of one positive label, as Spark jobs.

Sub-packages: ``functions`` (column expressions), ``operators`` (DataFrame
operators and estimators), ``sources`` (reads, writes, model bundles),
``plans`` (bindings of the operators to the test tables, registered queries and
their SQL oracles), ``streaming`` (submission intake as a stream).
"""
__version__ = "0.1.0"
