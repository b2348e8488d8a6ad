"""stormframe: a Spark-native engine for storm-bulletin analytics.

Everything is expressed as DataFrame transformations; see README.md for the
map from operators to modules.
"""
