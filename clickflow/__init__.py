"""clickflow: session analytics on Spark DataFrames.

Click events in, one feature row per session, feature ranking, cross-fitted
predictions and a checked submission out. See README.md.
"""

__version__ = "0.1.0"
