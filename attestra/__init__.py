"""Attestra: research-integrity analytics and training-data preparation on PySpark.

Every operator is a pure function from DataFrames to DataFrames. Operators report
findings and leave their inputs as they are.
"""

__version__ = "0.1.0"
