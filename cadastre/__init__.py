"""cadastre: a PySpark engine for provider catalogues and source indexes.

``sources``    readers and writers (symbol files, snapshots, pages, diffs)
``functions``  column expressions that stay inside whole-stage codegen
``operators``  DataFrame -> DataFrame jobs
``streaming``  Structured Streaming jobs and their batch twins
``plans``      the registered queries over the driver's tables
"""
