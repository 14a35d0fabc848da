"""flowforge: flow-record preparation, labelling and extractor benchmarking
expressed as Spark DataFrame plans.

Subpackages: ``functions`` (column expressions, cleaning, schemas),
``sources`` / ``sinks`` (file formats), ``operators`` (aggregates, joins,
ranking, sampling, encoding, modelling), ``plans`` (end-to-end jobs and the
stand-in queries), ``streaming`` (the row-level jobs on streams).
"""

__version__ = "0.1.0"
