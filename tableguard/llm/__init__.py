"""Operations of a training-data pipeline over document tables.

Every operator takes and returns DataFrames. Work on texts runs in Arrow batches inside Spark's
tasks; anything that has to meet across documents goes through Spark's shuffles, joins and
aggregates. The package must be importable on the executors, as any library that is handed over
with ``--py-files``.
"""
