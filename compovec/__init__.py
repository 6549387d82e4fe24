"""Document composition analytics as PySpark DataFrame transformations.

Documents become sentences, sentences become label sets, the most important
sentences of each document become a composition vector, and vectors become
cohort statistics.  Every public function takes and returns DataFrames (or
column expressions); only fixed-size summaries ever reach the driver.
"""
