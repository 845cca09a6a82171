"""timberline: log analytics as Spark DataFrame jobs.

Raw log lines go in as a ``(source, line_no, value)`` DataFrame; typed entry
tables, statistics and report tables come out as DataFrames.
"""
