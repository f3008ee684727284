"""spendlabel: labelling transactions with categories as Spark table and stream jobs.

Sub-packages
------------
functions   column expressions (text, dates, amounts, hashing); no data movement
sources     CSV readers/writers, the versioned table store, the synthetic generator
operators   DataFrame operators: cleaning, validation, joins, maintenance,
            features, model training/scoring, metrics
plans       fixture views over the shared tables and the registered query catalog
streaming   Structured Streaming jobs built on the operators
"""

__version__ = "0.1.0"
