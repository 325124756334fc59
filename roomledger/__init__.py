"""Booking analytics as plain ``DataFrame -> DataFrame`` functions on Spark.

``sources``   reading and writing booking tables, country map and insights
``functions`` column expressions shared by the operators
``operators`` clean-up, features, filters, joins, reports, statistics, text, vectors
``plans``     whole jobs built from the operators: merge and clean, insights, questions
"""
