"""Item-text cleaning and hierarchical classification as Spark jobs.

The package is organised by what a step does to a DataFrame:

``sources``    reading and writing (SQL text, delimited files, term lists, models, results)
``functions``  column expressions (word splitting, pattern building, hashing)
``operators``  DataFrame -> DataFrame steps (filters, joins, cleaning, features, naive Bayes, reports)
``plans``      compositions of operators (preparation, training, cross-validation, batch prediction)
``catalog``    the queries registered in ``__spark_entry__.py`` and their SQL
"""

__version__ = "0.1.0"
